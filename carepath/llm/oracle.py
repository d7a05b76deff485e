"""DuckDB SQL for the operators whose whole result SQL can express."""

from __future__ import annotations

CHAT_TREES = r"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text))
         AS loss_sha256,
       CAST(3 + sum(7 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g'))) AS BIGINT)
         AS formatted_chars
FROM t GROUP BY conv_id"""

# Levels of hashing that the query unrolls: 16^6 documents of a source, 16^3 sources.
MERKLE_LEVELS, MERKLE_TOP = 6, 3


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(text: str) -> str:
    fields = " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({fields})"


def _tree(name: str, base: str, levels: int) -> str:
    """CTEs ``{name}0`` .. of nodes (tree, pos, h, n) and ``{name}_run0`` .. of their runs of 16."""
    out = [f"{name}0 AS ({base})"]
    for k in range(levels):
        out.append(
            f"{name}_run{k} AS (SELECT tree, pos // 16 AS run, n, list(h ORDER BY pos) AS hs FROM {name}{k} "
            "GROUP BY tree, pos // 16, n)"
        )
        out.append(
            f"{name}{k + 1} AS (SELECT tree, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END "
            f"AS h, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n FROM {name}_run{k})"
        )
    return ",\n".join(out)


def _climb(name: str, tree: str, start: str, levels: int) -> str:
    """CTEs ``{name}0`` .. of rows (row, tree, pos, cur, proof) on their way up ``tree``."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        left, right = "hs[1:p.pos % 16]", "hs[p.pos % 16 + 2:]"
        out.append(
            f"{name}{k + 1} AS (SELECT p.row, p.tree, p.pos // 16 AS pos, "
            f"CASE WHEN n > 1 THEN sha256(array_to_string(list_concat({left}, [p.cur], {right}), '')) ELSE p.cur END AS cur, "
            f"CASE WHEN n > 1 THEN p.proof || array_to_string(list_concat({left}, {right}), '') ELSE p.proof END AS proof "
            f"FROM {name}{k} p JOIN {tree}_run{k} r ON r.tree = p.tree AND r.run = p.pos // 16)"
        )
    return ",\n".join(out)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 of the decimal id, bit by bit: each byte is followed by eight shifts (-1).
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
  string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

MERKLE_MANIFEST = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {_leaf('text')} AS leaf,
                  CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_leaf(_LOWERED)} END AS tampered FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS row FROM d),
{_tree('l', 'SELECT tree, pos, leaf AS h, n FROM b', MERKLE_LEVELS)},
s AS (SELECT tree AS member, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM l{MERKLE_LEVELS}),
{_tree('t', "SELECT '' AS tree, pos, h, n FROM s", MERKLE_TOP)},
{_climb('p', 'l', "SELECT row, tree, pos, COALESCE(tampered, leaf) AS cur, '' AS proof FROM b", MERKLE_LEVELS)},
{_climb('q', 't', f"SELECT p.row, '' AS tree, s.pos, p.cur, p.proof FROM p{MERKLE_LEVELS} p JOIN s ON s.member = p.tree", MERKLE_TOP)}
SELECT b.doc_id, b.leaf, s.h AS subroot, t.h AS root, sha256(q.proof) AS proof_sha256, q.cur AS folded_root,
       q.cur = t.h AS verified
FROM b JOIN q{MERKLE_TOP} q ON q.row = b.row JOIN s ON s.member = b.tree, t{MERKLE_TOP} t"""

ORACLE_SQL: dict[str, str] = {
    "op3_chat_trees": CHAT_TREES,
    "op11_merkle_manifest": MERKLE_MANIFEST,
}
