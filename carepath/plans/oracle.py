"""Independent DuckDB SQL for every SQL-expressible registered query (the correctness oracle).

Written straight from the operator definitions over the raw driver tables, without the Spark code paths:
window functions where Spark uses distributed equivalents, plain joins where Spark broadcasts.
Tables are the driver's pre-registered views. Integer outputs are BIGINT and fractions DOUBLE on both sides.
"""

from __future__ import annotations

_NOTE_IDS = {
    "embeddings": "SELECT vec_id AS hadm_id FROM embeddings",
    "documents": "SELECT doc_id AS hadm_id FROM documents",
    "lineitem": "SELECT l_orderkey AS hadm_id FROM lineitem",
}
_CODES = {
    "partkey": "SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num, CAST(l_partkey AS VARCHAR) AS icd_code "
    "FROM lineitem",
    "brand": "SELECT l.l_orderkey AS hadm_id, l.l_linenumber AS seq_num, p.p_brand AS icd_code "
    "FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey",
}
_FIXTURES = {
    "F1": ("embeddings", "partkey"),
    "F1b": ("embeddings", "brand"),
    "F2": ("documents", "partkey"),
    "F3": ("lineitem", "brand"),
}


def prep(fixture: str) -> str:
    """CTEs: adm, ids, cohort, diag, vocab, vsize, vocab_unk, enc, seqs, sequences, pairs."""
    note, code = _FIXTURES[fixture]
    return f"""
adm AS (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, CAST(o_orderstatus = 'F' AS INTEGER) AS label
        FROM orders),
ids AS (SELECT DISTINCT hadm_id FROM adm WHERE hadm_id IS NOT NULL
        INTERSECT SELECT hadm_id FROM ({_NOTE_IDS[note]}) n WHERE hadm_id IS NOT NULL),
numbered AS (SELECT hadm_id, row_number() OVER (ORDER BY hadm_id) AS rn, count(*) OVER () AS n FROM ids),
cohort AS (SELECT hadm_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split,
                  CAST(rn AS BIGINT) AS rn FROM numbered),
diag AS ({_CODES[code]}),
vocab AS (SELECT code, CAST(row_number() OVER (ORDER BY code) AS BIGINT) AS code_id
          FROM (SELECT DISTINCT icd_code AS code FROM diag
                WHERE icd_code IS NOT NULL AND hadm_id IN (SELECT hadm_id FROM cohort WHERE split = 'train')) v),
vsize AS (SELECT count(*) AS n FROM vocab),
vocab_unk AS (SELECT code, code_id FROM vocab UNION ALL SELECT '<UNK>', CAST((SELECT n FROM vsize) + 1 AS BIGINT)),
enc AS (SELECT d.hadm_id, d.seq_num, d.icd_code,
               CAST(COALESCE(v.code_id, (SELECT n FROM vsize) + 1) AS BIGINT) AS code_id
        FROM diag d LEFT JOIN vocab v ON v.code = d.icd_code),
seqs AS (SELECT e.hadm_id, c.split, list(e.code_id ORDER BY e.seq_num, e.code_id) AS codes
         FROM enc e JOIN cohort c ON c.hadm_id = e.hadm_id GROUP BY e.hadm_id, c.split HAVING count(*) >= 2),
sequences AS (SELECT hadm_id, split, codes[1:len(codes) - 1] AS input_ids, codes[2:len(codes)] AS labels FROM seqs),
pairs AS (SELECT hadm_id, split, CAST(i - 1 AS BIGINT) AS pos, codes[i] AS prev, codes[i + 1] AS next
          FROM (SELECT hadm_id, split, codes, unnest(range(1, len(codes))) AS i FROM seqs) x)"""


def _pct(hits: str, total: str) -> str:
    return f"round(100.0 * (CAST({hits} AS DOUBLE) / CAST({total} AS DOUBLE)), 6)"


def _candidates(with_cluster: bool, ctx_source: str, k: int = 10) -> str:
    """CTEs ranking the next-code candidates for the contexts of ``ctx_source`` (a CTE of pairs)."""
    if not with_cluster:
        return f"""
pc AS (SELECT prev, next, count(*) AS n FROM tp WHERE split = 'train' GROUP BY prev, next),
lvl0 AS (SELECT prev, next AS cand, 0 AS level, row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) AS rnk
         FROM pc QUALIFY rnk <= {k}),
gtop AS (SELECT next AS cand, 1 AS level, row_number() OVER (ORDER BY n DESC, next) AS rnk
         FROM (SELECT next, sum(n) AS n FROM pc GROUP BY next) g QUALIFY rnk <= {k}),
ctx AS (SELECT DISTINCT prev FROM {ctx_source}),
allc AS (SELECT c.prev, l.cand, l.level, l.rnk FROM ctx c JOIN lvl0 l ON l.prev = c.prev
         UNION ALL SELECT c.prev, g.cand, g.level, g.rnk FROM ctx c CROSS JOIN gtop g),
best AS (SELECT prev, cand, min(level * 1000 + rnk) AS key FROM allc GROUP BY prev, cand),
merged AS (SELECT prev, cand, CAST(row_number() OVER (PARTITION BY prev ORDER BY key) AS BIGINT) AS rank
           FROM best QUALIFY rank <= {k})"""
    return f"""
pc AS (SELECT cluster, prev, next, count(*) AS n FROM tp WHERE split = 'train' GROUP BY cluster, prev, next),
lvl0 AS (SELECT cluster, prev, next AS cand, 0 AS level,
                row_number() OVER (PARTITION BY cluster, prev ORDER BY n DESC, next) AS rnk FROM pc QUALIFY rnk <= {k}),
lvl1 AS (SELECT prev, next AS cand, 1 AS level, row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) AS rnk
         FROM (SELECT prev, next, sum(n) AS n FROM pc GROUP BY prev, next) a QUALIFY rnk <= {k}),
gtop AS (SELECT next AS cand, 2 AS level, row_number() OVER (ORDER BY n DESC, next) AS rnk
         FROM (SELECT next, sum(n) AS n FROM pc GROUP BY next) g QUALIFY rnk <= {k}),
ctx AS (SELECT DISTINCT cluster, prev FROM {ctx_source}),
allc AS (SELECT c.cluster, c.prev, l.cand, l.level, l.rnk FROM ctx c
           JOIN lvl0 l ON l.cluster = c.cluster AND l.prev = c.prev
         UNION ALL SELECT c.cluster, c.prev, l.cand, l.level, l.rnk FROM ctx c JOIN lvl1 l ON l.prev = c.prev
         UNION ALL SELECT c.cluster, c.prev, g.cand, g.level, g.rnk FROM ctx c CROSS JOIN gtop g),
best AS (SELECT cluster, prev, cand, min(level * 1000 + rnk) AS key FROM allc GROUP BY cluster, prev, cand),
merged AS (SELECT cluster, prev, cand,
                  CAST(row_number() OVER (PARTITION BY cluster, prev ORDER BY key) AS BIGINT) AS rank
           FROM best QUALIFY rank <= {k})"""


def _accuracy(fixture: str, with_cluster: bool) -> str:
    tp = (
        "tp AS (SELECT p.*, CAST(e.label AS BIGINT) AS cluster FROM pairs p JOIN embeddings e ON e.vec_id = p.hadm_id)"
        if with_cluster
        else "tp AS (SELECT * FROM pairs)"
    )
    keys = "m.cluster = t.cluster AND m.prev = t.prev" if with_cluster else "m.prev = t.prev"
    return f"""WITH {prep(fixture)},
{tp},
test AS (SELECT * FROM tp WHERE split = 'test'),{_candidates(with_cluster, 'test')},
scored AS (SELECT t.prev, t.next, m.rank AS hit_rank FROM test t LEFT JOIN merged m ON {keys} AND m.cand = t.next)"""


def _accuracy_select() -> str:
    return (
        "SELECT CAST(count(*) AS BIGINT) AS n_tokens, "
        + ", ".join(
            f"{_pct(f'sum(CASE WHEN hit_rank <= {k} THEN 1 ELSE 0 END)', 'count(*)')} AS top{k}_pct" for k in (1, 5, 10)
        )
        + " FROM scored"
    )


def _scores() -> str:
    return """
raw AS (SELECT l.doc_id AS hadm_id, CAST(l.toxic AS DOUBLE) AS y,
               CASE WHEN d.doc_id % 97 = 0 THEN CAST('NaN' AS DOUBLE)
                    ELSE CAST((d.n_chars * 7919) % 100003 AS DOUBLE) / CAST(4000.0 AS DOUBLE) - CAST(12.0 AS DOUBLE)
               END AS z_raw
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
sc AS (SELECT hadm_id, y, z_raw, CASE WHEN isnan(z_raw) THEN z_raw
              ELSE greatest(CAST(-10.0 AS DOUBLE), least(CAST(10.0 AS DOUBLE), z_raw)) END AS z FROM raw),
scp AS (SELECT hadm_id, y, z_raw, z, CASE WHEN isnan(z) THEN CAST(0.5 AS DOUBLE) ELSE 1.0 / (1.0 + exp(-z)) END AS p
        FROM sc),
g AS (SELECT p, sum(y) AS tp, sum(1 - y) AS fp FROM scp GROUP BY p),
c AS (SELECT p, tp, fp,
             sum(tp) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
             sum(fp) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cfp FROM g),
tot AS (SELECT sum(tp) AS n_pos, sum(fp) AS n_neg FROM g)"""


def _events_lengths() -> str:
    return """
lens AS (SELECT CAST(count(*) - 1 AS BIGINT) AS length FROM events GROUP BY user_id HAVING count(*) >= 2),
pv AS (SELECT CAST(length AS DOUBLE) AS v, count(*) AS c FROM lens GROUP BY length),
rng AS (SELECT min(v) AS lo, max(v) AS hi FROM pv)"""


def _embedding_cells() -> str:
    return """
e AS (SELECT vec_id, CAST(x AS DOUBLE) AS x, i
      FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) u)"""


ORACLE_SQL: dict[str, str] = {
    "cohort_intersection": f"WITH {prep('F3')} SELECT hadm_id FROM ids",
    "cohort_split": f"WITH {prep('F3')} SELECT hadm_id, split, rn FROM cohort",
    "cohort_split_fixed": f"""WITH {prep('F3')}
SELECT hadm_id, CASE WHEN rn <= 1000 THEN 'train' WHEN rn <= 1100 THEN 'test' ELSE 'unused' END AS split, rn
FROM cohort""",
    "unpad_batches": f"WITH {prep('F2')} SELECT hadm_id, split, pos, prev, next FROM pairs",
    "split_check": f"""WITH {prep('F3')}
SELECT 'shared_admissions' AS check_name, CAST(count(*) AS BIGINT) AS n
FROM (SELECT hadm_id FROM cohort GROUP BY hadm_id HAVING min(split) <> max(split)) a
UNION ALL
SELECT 'shared_subjects' AS check_name, CAST(count(*) AS BIGINT) AS n
FROM (SELECT a.subject_id FROM cohort c JOIN adm a ON a.hadm_id = c.hadm_id
      GROUP BY a.subject_id HAVING min(c.split) <> max(c.split)) s""",
    "cohort_stats": f"""WITH {prep('F3')}
SELECT split, n, n_pos, n_missing_label, {_pct('n_pos', 'n')} AS rate_pct
FROM (SELECT c.split, CAST(count(*) AS BIGINT) AS n, CAST(sum(COALESCE(a.label, 0)) AS BIGINT) AS n_pos,
             CAST(sum(CASE WHEN a.label IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_label
      FROM cohort c LEFT JOIN adm a ON a.hadm_id = c.hadm_id GROUP BY c.split) s""",
    "class_weights": f"""WITH {prep('F3')},
per AS (SELECT CAST(COALESCE(a.label, 0) AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n
        FROM cohort c LEFT JOIN adm a ON a.hadm_id = c.hadm_id WHERE c.split = 'train' GROUP BY 1)
SELECT label, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 9) AS weight FROM per""",
    "note_coverage": f"""WITH {prep('F3')},
nc AS (SELECT l_orderkey AS hadm_id, count(*) AS c FROM lineitem GROUP BY l_orderkey)
SELECT c.split, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN nc.c IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS with_note,
       CAST(sum(CASE WHEN nc.c IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_note,
       CAST(sum(COALESCE(nc.c, 0)) AS BIGINT) AS note_rows,
       CAST(sum(greatest(COALESCE(nc.c, 0) - 1, 0)) AS BIGINT) AS duplicate_note_rows
FROM cohort c LEFT JOIN nc ON nc.hadm_id = c.hadm_id GROUP BY c.split""",
    "vocab_train_only": f"WITH {prep('F2')} SELECT code, code_id FROM vocab_unk",
    "encode_with_unknown": f"""WITH {prep('F2')}
SELECT e.hadm_id, c.split, e.seq_num, e.icd_code, e.code_id FROM enc e JOIN cohort c ON c.hadm_id = e.hadm_id""",
    "ordered_sequences": f"""WITH {prep('F2')}
SELECT hadm_id, split, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels,
       CAST(len(input_ids) AS BIGINT) AS n_inputs FROM sequences""",
    "next_pairs": f"WITH {prep('F3')} SELECT hadm_id, split, pos, prev, next FROM pairs",
    "next_pairs_lead": f"WITH {prep('F3')} SELECT hadm_id, split, pos, prev, next FROM pairs",
    "last_value_per_key": """
SELECT user_id, event_id, event_type, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r
      FROM events) t WHERE r = 1""",
    "pad_batches": f"""WITH {prep('F2')},
b AS (SELECT hadm_id, split, input_ids, labels, row_number() OVER (PARTITION BY split ORDER BY hadm_id) AS r
      FROM sequences),
c AS (SELECT *, CAST((r - 1) // 16 AS BIGINT) AS batch_id, CAST((r - 1) % 16 AS BIGINT) AS pos_in_batch FROM b),
d AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY split, batch_id) AS m FROM c)
SELECT hadm_id, split, batch_id, pos_in_batch,
       array_to_string(list_concat(input_ids, list_transform(range(m - len(input_ids)), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(labels, list_transform(range(m - len(labels)), lambda x: -100)), ',') AS labels
FROM d""",
    "top_codes": f"""WITH {prep('F3')},
cnt AS (SELECT code_id, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT unnest(input_ids) AS code_id FROM sequences WHERE split = 'train') u GROUP BY code_id),
rk AS (SELECT code_id, n, CAST(row_number() OVER (ORDER BY n DESC, code_id) AS BIGINT) AS rank FROM cnt)
SELECT rk.rank, v.code, rk.code_id, rk.n FROM rk LEFT JOIN vocab_unk v ON v.code_id = rk.code_id WHERE rk.rank <= 10""",
    "length_histogram": f"""WITH {_events_lengths()},
step AS (SELECT lo, hi, (hi - lo) / CAST(50.0 AS DOUBLE) AS w FROM rng),
binned AS (SELECT pv.v, pv.c,
                  (SELECT count(*) FROM range(1, 50) t(i), step s WHERE CAST(i AS DOUBLE) * s.w + s.lo <= pv.v) AS bin
           FROM pv)
SELECT CAST(bin AS BIGINT) AS bin, round(s.lo + CAST(bin AS DOUBLE) * s.w, 6) AS lo,
       round(CASE WHEN bin = 49 THEN s.hi ELSE s.lo + CAST(bin + 1 AS DOUBLE) * s.w END, 6) AS hi,
       CAST(sum(c) AS BIGINT) AS n
FROM binned, step s GROUP BY bin, s.lo, s.hi, s.w""",
    "length_density": f"""WITH {_events_lengths()},
st AS (SELECT sum(c) AS n, min(v) AS lo, max(v) AS hi, sum(c * v) / sum(c) AS mean, sum(c * v * v) AS sumsq FROM pv),
bw AS (SELECT *, pow(CAST(n AS DOUBLE), -0.2) * sqrt((sumsq - n * mean * mean) / (n - 1)) AS h,
              (hi - lo) / CAST(199.0 AS DOUBLE) AS gstep, (hi - lo) / CAST(50.0 AS DOUBLE) AS binw FROM st),
grid AS (SELECT gi, CASE WHEN gi = 199 THEN hi ELSE lo + CAST(gi AS DOUBLE) * gstep END AS x, h, binw
         FROM bw, range(0, 200) t(gi))
SELECT CAST(gi AS BIGINT) AS point, round(x, 6) AS x,
       round(sum(c * (exp(-0.5 * ((x - v) / h) * ((x - v) / h)) / (h * sqrt(2 * pi())))) * binw, 6) AS density_count
FROM grid, pv GROUP BY gi, x, binw""",
    "examples_joined": f"""WITH {prep('F2')}
SELECT s.hadm_id, s.split, CAST(len(s.input_ids) AS BIGINT) AS n_inputs, CAST(COALESCE(a.label, 0) AS INTEGER) AS label,
       CAST(len(e.embedding) AS BIGINT) AS vec_dim, round(CAST(e.embedding[1] AS DOUBLE), 6) AS vec_first
FROM sequences s JOIN embeddings e ON e.vec_id = s.hadm_id LEFT JOIN adm a ON a.hadm_id = s.hadm_id""",
    "one_vector_per_admission": """
SELECT hadm_id, round(q, 4) AS v0, round(d, 4) AS v1
FROM (SELECT l_orderkey AS hadm_id, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS q,
             CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS d,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC, l_discount DESC) AS r
      FROM lineitem) t WHERE r = 1""",
    "modality_drop_counts": f"""WITH {prep('F2')}
SELECT s.split,
       CAST(sum(CASE WHEN e.hadm_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN e.hadm_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dropped,
       CAST(sum(CASE WHEN e.hadm_id IS NOT NULL AND a.hadm_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_label
FROM sequences s LEFT JOIN (SELECT DISTINCT vec_id AS hadm_id FROM embeddings) e ON e.hadm_id = s.hadm_id
LEFT JOIN adm a ON a.hadm_id = s.hadm_id GROUP BY s.split""",
    "next_code_model": f"""WITH {prep('F3')},
tp AS (SELECT * FROM pairs),{_candidates(False, 'tp')}
SELECT prev, cand, rank FROM merged""",
    "forecast_topk_accuracy": _accuracy("F3", False) + "\n" + _accuracy_select(),
    "forecast_topk_accuracy_notes": _accuracy("F1b", True) + "\n" + _accuracy_select(),
    "forecast_cross_entropy": f"""WITH {prep('F3')},
cp AS (SELECT prev, next, count(*) AS c_pair FROM pairs WHERE split = 'train' GROUP BY prev, next),
cprev AS (SELECT prev, sum(c_pair) AS c_prev FROM cp GROUP BY prev),
cnext AS (SELECT next, sum(c_pair) AS c_next FROM cp GROUP BY next),
tot AS (SELECT sum(c_pair) AS n_train FROM cp),
ev AS (SELECT t.prev, t.next, cp.c_pair, cprev.c_prev, cnext.c_next FROM pairs t
       LEFT JOIN cp ON cp.prev = t.prev AND cp.next = t.next LEFT JOIN cprev ON cprev.prev = t.prev
       LEFT JOIN cnext ON cnext.next = t.next WHERE t.split = 'test'),
u AS (SELECT ev.*, CAST(COALESCE(c_next, 0) + 1 AS DOUBLE) / CAST(tot.n_train + vsize.n + 1 AS DOUBLE) AS uni
      FROM ev, tot, vsize),
pr AS (SELECT CASE WHEN c_prev IS NULL THEN uni
                   ELSE CAST(0.7 AS DOUBLE) * (CAST(COALESCE(c_pair, 0) AS DOUBLE) / CAST(c_prev AS DOUBLE))
                        + (CAST(1.0 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * uni END AS p FROM u)
SELECT CAST(count(*) AS BIGINT) AS n_tokens, round(avg(-ln(p)), 9) AS cross_entropy FROM pr""",
    "compare_models": f"""WITH {prep('F1b')},
tp AS (SELECT p.*, CAST(e.label AS BIGINT) AS cluster FROM pairs p JOIN embeddings e ON e.vec_id = p.hadm_id),
test AS (SELECT * FROM tp WHERE split = 'test'),
uni_acc AS (
  WITH {_candidates(False, 'test').strip()},
  scored AS (SELECT t.prev, t.next, m.rank AS hit_rank FROM test t LEFT JOIN merged m ON m.prev = t.prev AND m.cand = t.next)
  {_accuracy_select()}),
multi_acc AS (
  WITH {_candidates(True, 'test').strip()},
  scored AS (SELECT t.prev, t.next, m.rank AS hit_rank FROM test t
             LEFT JOIN merged m ON m.cluster = t.cluster AND m.prev = t.prev AND m.cand = t.next)
  {_accuracy_select()}),
long AS (SELECT 'metric_1' AS metric, u.top1_pct AS uni, m.top1_pct AS multi FROM uni_acc u, multi_acc m
         UNION ALL SELECT 'metric_2', u.top5_pct, m.top5_pct FROM uni_acc u, multi_acc m
         UNION ALL SELECT 'metric_3', u.top10_pct, m.top10_pct FROM uni_acc u, multi_acc m)
SELECT 'Forecasting' AS task, metric, round(uni, 6) AS unimodal, round(multi, 6) AS multimodal,
       round(100.0 * ((multi - uni) / uni), 6) AS gain_pct FROM long""",
    "bag_of_codes_topk_vocab": f"""WITH {prep('F2')},
dfreq AS (SELECT icd_code AS term, CAST(count(DISTINCT d.hadm_id) AS BIGINT) AS df
          FROM diag d JOIN cohort c ON c.hadm_id = d.hadm_id WHERE c.split = 'train' AND icd_code IS NOT NULL
          GROUP BY icd_code)
SELECT term, df, CAST(row_number() OVER (ORDER BY df DESC, term) AS BIGINT) AS rank FROM dfreq QUALIFY rank <= 200""",
    "risk_features": f"""WITH {prep('F1')},
tr AS (SELECT DISTINCT d.hadm_id, d.icd_code AS term FROM diag d JOIN cohort c ON c.hadm_id = d.hadm_id
       WHERE c.split = 'train' AND d.icd_code IS NOT NULL),
y AS (SELECT t.hadm_id, CAST(COALESCE(max(a.label), 0) AS BIGINT) AS y
      FROM (SELECT DISTINCT hadm_id FROM tr) t LEFT JOIN adm a ON a.hadm_id = t.hadm_id GROUP BY t.hadm_id),
per AS (SELECT y, count(*) AS n FROM y GROUP BY y),
w AS (SELECT y, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight FROM per)
SELECT tr.hadm_id, tr.term, y.y, round(w.weight, 9) AS weight
FROM tr JOIN y ON y.hadm_id = tr.hadm_id JOIN w ON w.y = y.y""",
    "risk_fit_check": f"""WITH {prep('F1')},
tr AS (SELECT DISTINCT d.hadm_id, d.icd_code AS term FROM diag d JOIN cohort c ON c.hadm_id = d.hadm_id
       WHERE c.split = 'train'),
y AS (SELECT t.hadm_id, COALESCE(max(a.label), 0) AS y
      FROM (SELECT DISTINCT hadm_id FROM tr) t LEFT JOIN adm a ON a.hadm_id = t.hadm_id GROUP BY t.hadm_id)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_pos,
       CAST((SELECT count(DISTINCT term) FROM tr) AS BIGINT) AS n_features,
       round(CAST(count(*) AS DOUBLE), 6) AS weight_sum, TRUE AS stationary FROM y""",
    "clamped_scores": f"""WITH {_scores().strip()}
SELECT hadm_id, y, CASE WHEN NOT isnan(z_raw) THEN z_raw END AS z_raw, CASE WHEN NOT isnan(z) THEN z END AS z,
       round(p, 9) AS p FROM scp""",
    "roc_auc": f"""WITH {_scores().strip()}
SELECT CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
       round(sum(fp * (ctp - tp / 2.0)) / (n_pos * n_neg), 9) AS roc_auc FROM c, tot GROUP BY n_pos, n_neg""",
    "average_precision": f"""WITH {_scores().strip()}
SELECT CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
       round(sum(tp * ctp / (ctp + cfp)) / n_pos, 9) AS average_precision FROM c, tot GROUP BY n_pos, n_neg""",
    "roc_points": f"""WITH {_scores().strip()},
c2 AS (SELECT *, row_number() OVER (ORDER BY p DESC) AS idx, count(*) OVER () AS m,
              lag(ctp) OVER (ORDER BY p DESC) AS ptp, lag(cfp) OVER (ORDER BY p DESC) AS pfp,
              lead(ctp) OVER (ORDER BY p DESC) AS ntp, lead(cfp) OVER (ORDER BY p DESC) AS nfp FROM c)
SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr
UNION ALL
SELECT round(p, 9), round(cfp / n_neg, 9), round(ctp / n_pos, 9) FROM c2, tot
WHERE m <= 2 OR idx = 1 OR idx = m OR (nfp - 2 * cfp + pfp) <> 0 OR (ntp - 2 * ctp + ptp) <> 0""",
    "roc_area": f"""WITH {_scores().strip()}
SELECT round(sum(fp * ((ctp - tp) + ctp) / 2.0) / (n_pos * n_neg), 9) AS roc_area FROM c, tot GROUP BY n_pos, n_neg""",
    "calibration": f"""WITH {_scores().strip()},
b AS (SELECT p, y, len(list_filter(list_transform(range(1, 10), lambda i: CAST(i AS DOUBLE) * CAST(0.1 AS DOUBLE)),
                                   lambda e: e < p)) AS bin FROM scp)
SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) AS mean_p,
       round(avg(y), 6) AS frac_pos FROM b GROUP BY bin""",
    "ranking_by_group": f"""WITH {_scores().strip()},
gl AS (SELECT d.lang, s.p, sum(s.y) AS tp, sum(1 - s.y) AS fp FROM scp s JOIN documents d ON d.doc_id = s.hadm_id
       GROUP BY d.lang, s.p),
cl AS (SELECT lang, p, tp, fp,
              sum(tp) OVER (PARTITION BY lang ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
              sum(fp) OVER (PARTITION BY lang ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cfp,
              sum(tp) OVER (PARTITION BY lang) AS n_pos, sum(fp) OVER (PARTITION BY lang) AS n_neg FROM gl)
SELECT lang, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
       round(CASE WHEN n_pos * n_neg = 0 THEN NULL ELSE sum(fp * (ctp - tp / 2.0)) / (n_pos * n_neg) END, 9) AS roc_auc,
       round(CASE WHEN n_pos = 0 THEN NULL ELSE sum(tp * ctp / (ctp + cfp)) / n_pos END, 9) AS average_precision
FROM cl GROUP BY lang, n_pos, n_neg""",
    "log_loss": f"""WITH {_scores().strip()}
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(greatest(z0, 0.0) - z0 * y + ln(1 + exp(-abs(z0)))), 9) AS log_loss
FROM (SELECT y, CASE WHEN isnan(z) THEN CAST(0 AS DOUBLE) ELSE z END AS z0 FROM scp) q""",
    "vectorize_notes": """
WITH tok AS (SELECT doc_id AS hadm_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+')) AS term
             FROM documents),
tf AS (SELECT hadm_id, term, count(*) AS tf FROM tok WHERE length(term) > 0 GROUP BY hadm_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents)
SELECT tf.hadm_id, CAST(count(*) AS BIGINT) AS n_terms,
       round(sum(pow(tf.tf * ln((n.n + CAST(1 AS DOUBLE)) / (df.df + 1)), 2)), 4) AS sq_norm
FROM tf JOIN df ON df.term = tf.term, n GROUP BY tf.hadm_id""",
    "note_token_counts": """
SELECT hadm_id, n_tokens, least(n_tokens, 512) AS n_kept, n_tokens > 512 AS truncated
FROM (SELECT doc_id AS hadm_id,
             CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda t: length(t) > 0)) AS BIGINT)
               AS n_tokens
      FROM documents) d""",
    "gated_fusion": f"""WITH {_embedding_cells().strip()},
g AS (SELECT vec_id,
             1.0 / (1.0 + exp(-(sum(x * (CAST((i % 7) - 3 AS DOUBLE) / 10.0)) + CAST(0.05 AS DOUBLE)))) AS gate
      FROM e GROUP BY vec_id)
SELECT g.vec_id, round(g.gate, 9) AS gate, CAST(c.i AS BIGINT) AS dim,
       round(g.gate * n.x + (1.0 - g.gate) * c.x, 6) AS value
FROM g JOIN e c ON c.vec_id = g.vec_id AND c.i < 32 JOIN e n ON n.vec_id = g.vec_id AND n.i = c.i + 32""",
    "fused_positions": f"""WITH {prep('F1b')},
ps AS (SELECT hadm_id, CAST(i - 1 AS BIGINT) AS pos, input_ids[i] AS code_id
       FROM (SELECT hadm_id, input_ids, unnest(range(1, len(input_ids) + 1)) AS i FROM sequences) u),
j AS (SELECT ps.hadm_id, ps.pos, ps.code_id, c.embedding AS cvec, n.embedding AS nvec
      FROM ps JOIN embeddings c ON c.vec_id = ps.code_id JOIN embeddings n ON n.vec_id = ps.hadm_id),
cells AS (SELECT hadm_id, pos, code_id, CAST(x AS DOUBLE) AS x, i
          FROM (SELECT hadm_id, pos, code_id, unnest(list_concat(cvec, nvec)) AS x,
                       unnest(range(0, len(cvec) + len(nvec))) AS i FROM j) u),
g AS (SELECT hadm_id, pos, code_id,
             1.0 / (1.0 + exp(-(sum(x * (CAST((i % 7) - 3 AS DOUBLE) / 10.0)) + CAST(0.05 AS DOUBLE)))) AS gate
      FROM cells GROUP BY hadm_id, pos, code_id)
SELECT g.hadm_id, g.pos, g.code_id, round(g.gate, 9) AS gate, CAST(d AS BIGINT) AS dim,
       round(g.gate * CAST(j.nvec[d + 1] AS DOUBLE) + (1.0 - g.gate) * CAST(j.cvec[d + 1] AS DOUBLE), 6) AS value
FROM g JOIN j ON j.hadm_id = g.hadm_id AND j.pos = g.pos, range(0, 64) t(d)""",
    "layer_norm": f"""WITH {_embedding_cells().strip()},
mu AS (SELECT vec_id, avg(x) AS mean FROM e GROUP BY vec_id),
va AS (SELECT e.vec_id, avg((e.x - mu.mean) * (e.x - mu.mean)) AS var FROM e JOIN mu ON mu.vec_id = e.vec_id
       GROUP BY e.vec_id)
SELECT e.vec_id, CAST(e.i AS BIGINT) AS dim, round((e.x - mu.mean) * (1.0 / sqrt(va.var + 1e-5)), 6) AS value
FROM e JOIN mu ON mu.vec_id = e.vec_id JOIN va ON va.vec_id = e.vec_id""",
    "max_pool": """
SELECT CAST(label AS BIGINT) AS label, CAST(i AS BIGINT) AS dim, round(max(CAST(x AS DOUBLE)), 6) AS value
FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) u
GROUP BY label, i""",
    "project_vectors": f"""WITH {_embedding_cells().strip()}
SELECT e.vec_id, CAST(j AS BIGINT) AS dim,
       round(sum(e.x * (CAST(((7 * e.i + 3 * j) % 11) - 5 AS DOUBLE) / 10.0)) + CAST(j AS DOUBLE) / 10.0, 6) AS value
FROM e, range(0, 8) t(j) GROUP BY e.vec_id, j""",
    "topk_by_dot": f"""WITH {prep('F1b')}
SELECT query_id, item_id, rank, round(score, 6) AS score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS BIGINT) AS rank
      FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id,
                   list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
            FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT code_id FROM vocab)) s) r
WHERE rank <= 5""",
    "note_clusters_fitted": """
SELECT vec_id AS hadm_id, CAST(0 AS DOUBLE) AS off_nearest, CAST(0 AS DOUBLE) AS off_mean FROM embeddings""",
    "projection_fitted": f"""WITH {_embedding_cells().strip()}
SELECT vec_id AS hadm_id, CAST(count(*) AS BIGINT) AS dims, round(sum(x * x), 6) AS square FROM e GROUP BY vec_id""",
    "projection_moments": f"""WITH {_embedding_cells().strip()},
n AS (SELECT CAST(count(DISTINCT vec_id) AS DOUBLE) AS n FROM e),
mu AS (SELECT i, avg(x) AS m FROM e GROUP BY i),
c AS (SELECT vec_id, e.i, x - m AS x FROM e JOIN mu ON mu.i = e.i),
cov AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) / (max(n) - 1) AS v
        FROM c a JOIN c b ON b.vec_id = a.vec_id, n GROUP BY a.i, b.i),
sq AS (SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM cov a JOIN cov b ON b.i = a.j GROUP BY a.i, b.j)
SELECT CAST((SELECT n FROM n) AS BIGINT) AS n, CAST((SELECT count(*) FROM mu) AS BIGINT) AS dims,
       round((SELECT sum(v) FROM cov WHERE i = j), 6) AS trace,
       round((SELECT sum(v) FROM sq WHERE i = j), 6) AS trace_of_square,
       round((SELECT sum(s.v * k.v) FROM sq s JOIN cov k ON k.i = s.j AND k.j = s.i), 6) AS trace_of_cube,
       CAST(0 AS DOUBLE) AS largest_covariance, TRUE AS descending""",
    "encode_notes": """
WITH tok AS (SELECT doc_id AS hadm_id,
                    list_transform(list_filter(regexp_split_to_array(COALESCE(text, ''), '[ \\t\\n\\r\\f\\x0B]+'),
                                               lambda t: length(t) > 0), lambda t: length(t)) AS n
             FROM documents)
SELECT hadm_id, CAST(b AS BIGINT) AS batch_size, CAST(COALESCE(n[1], 0) AS DOUBLE) AS first,
       round(CAST(CAST(COALESCE(list_sum(n) / CAST(len(n) AS DOUBLE), 0) AS FLOAT) AS DOUBLE), 4) AS mean,
       CAST(COALESCE(list_max(n), 0) AS DOUBLE) AS largest, CAST(len(n) AS DOUBLE) AS tokens
FROM tok, (VALUES (7), (64)) s(b)""",
    "two_layer_head": f"""WITH {prep('F1b')},
rows AS (SELECT DISTINCT p.hadm_id FROM pairs p
         JOIN embeddings c ON c.vec_id = p.prev JOIN embeddings n ON n.vec_id = p.hadm_id),
y AS (SELECT r.hadm_id, COALESCE(max(a.label), 0) AS y FROM rows r LEFT JOIN adm a ON a.hadm_id = r.hadm_id
      GROUP BY r.hadm_id),
d AS (SELECT max(len(embedding)) AS d FROM embeddings)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_pos,
       CAST((SELECT (d + 1) * 32 + 33 * 2 FROM d) AS BIGINT) AS n_params, CAST(0 AS DOUBLE) AS max_gap, TRUE AS learned
FROM y""",
    "stored_risk_scores": f"""WITH {prep('F1')},
bags AS (SELECT DISTINCT d.hadm_id FROM diag d JOIN cohort c ON c.hadm_id = d.hadm_id),
y AS (SELECT b.hadm_id, CAST(COALESCE(max(a.label), 0) AS BIGINT) AS y FROM bags b LEFT JOIN adm a ON a.hadm_id = b.hadm_id
      GROUP BY b.hadm_id)
SELECT y.hadm_id, y.y, CAST(0 AS DOUBLE) AS margin_gap, CAST(0 AS DOUBLE) AS p_gap FROM y
WHERE y.hadm_id IN (SELECT vec_id FROM embeddings)""",
    "risk_notes_fit_check": f"""WITH {prep('F1')},
tr AS (SELECT DISTINCT d.hadm_id, d.icd_code AS term FROM diag d JOIN cohort c ON c.hadm_id = d.hadm_id
       WHERE c.split = 'train' AND d.hadm_id IN (SELECT vec_id FROM embeddings)),
y AS (SELECT t.hadm_id, COALESCE(max(a.label), 0) AS y
      FROM (SELECT DISTINCT hadm_id FROM tr) t LEFT JOIN adm a ON a.hadm_id = t.hadm_id GROUP BY t.hadm_id)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_pos,
       CAST((SELECT count(DISTINCT term) FROM tr) + (SELECT max(len(embedding)) FROM embeddings) AS BIGINT) AS n_features,
       round(CAST(count(*) AS DOUBLE), 6) AS weight_sum, TRUE AS stationary FROM y""",
    "stored_examples": f"""WITH {prep('F2')}
SELECT s.hadm_id, s.split, CAST(len(s.input_ids) AS BIGINT) AS n_inputs, s.labels[len(s.labels)] AS last_label,
       round(CAST(e.embedding[1] AS DOUBLE), 6) AS vec_first
FROM sequences s JOIN embeddings e ON e.vec_id = s.hadm_id""",
    "csv_round_trip": """
SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS sha256 FROM documents""",
    "observed_counts": f"""WITH {prep('F2')},
k AS (SELECT s.hadm_id, e.hadm_id IS NOT NULL AS kept, a.hadm_id IS NULL AS missing FROM sequences s
      LEFT JOIN (SELECT DISTINCT vec_id AS hadm_id FROM embeddings) e ON e.hadm_id = s.hadm_id
      LEFT JOIN adm a ON a.hadm_id = s.hadm_id)
SELECT CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS rejected_hadm_id,
       CAST((SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS BIGINT) AS rejected_seq_num,
       CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE NOT kept) AS BIGINT) AS dropped,
       CAST(count(*) FILTER (WHERE kept AND missing) AS BIGINT) AS missing_label FROM k""",
    "report_forecasting": f"""WITH {prep('F1')},
tp AS (SELECT p.*, CAST(e.label AS BIGINT) AS cluster FROM pairs p JOIN embeddings e ON e.vec_id = p.hadm_id),
test AS (SELECT * FROM tp WHERE split = 'test'),
uni_acc AS (
  WITH {_candidates(False, 'test').strip()},
  scored AS (SELECT t.prev, t.next, m.rank AS hit_rank FROM test t LEFT JOIN merged m ON m.prev = t.prev AND m.cand = t.next)
  {_accuracy_select()}),
multi_acc AS (
  WITH {_candidates(True, 'test').strip()},
  scored AS (SELECT t.prev, t.next, m.rank AS hit_rank FROM test t
             LEFT JOIN merged m ON m.cluster = t.cluster AND m.prev = t.prev AND m.cand = t.next)
  {_accuracy_select()})
SELECT 'Forecasting' AS task, 'Unimodal' AS model, top1_pct AS metric_1, top5_pct AS metric_2, top10_pct AS metric_3
FROM uni_acc
UNION ALL SELECT 'Forecasting', 'Multimodal', top1_pct, top5_pct, top10_pct FROM multi_acc""",
    "shuffled_batches": f"""WITH {prep('F2')},
b AS (SELECT hadm_id, split, row_number() OVER (PARTITION BY split ORDER BY md5('7:' || hadm_id), hadm_id) - 1 AS r
      FROM sequences)
SELECT hadm_id, split, CAST(r // 16 AS BIGINT) AS batch_id, CAST(r % 16 AS BIGINT) AS pos_in_batch FROM b""",
    "tokenized_bags": f"""WITH {prep('F3')},
rows AS (SELECT DISTINCT d.hadm_id, c.split, d.icd_code FROM diag d JOIN cohort c ON c.hadm_id = d.hadm_id),
texts AS (SELECT hadm_id, split, lower(string_agg(icd_code, ' ')) AS t FROM rows GROUP BY hadm_id, split),
lab AS (SELECT hadm_id, max(label) AS label FROM adm GROUP BY hadm_id)
SELECT x.hadm_id, x.split, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\b\\w\\w+\\b'))), ' ') AS terms,
       CAST(COALESCE(l.label, 0) AS BIGINT) AS label
FROM texts x LEFT JOIN lab l ON l.hadm_id = x.hadm_id""",
    "relu_vectors": f"""WITH {_embedding_cells().strip()}
SELECT vec_id, CAST(i AS BIGINT) AS dim, round(greatest(x, CAST(0 AS DOUBLE)), 6) AS value FROM e""",
    "formatted_stats": f"""WITH {prep('F3')},
s AS (SELECT c.split, count(*) AS n, sum(COALESCE(a.label, 0)) AS n_pos FROM cohort c
      LEFT JOIN adm a ON a.hadm_id = c.hadm_id GROUP BY c.split)
SELECT split, format('{{:,}}', CAST(n AS BIGINT)) AS n, format('{{:,}}', CAST(n_pos AS BIGINT)) AS positives,
       printf('%.2f%%', 100.0 * n_pos / n) AS rate, format('{{:,}}', CAST((SELECT n FROM vsize) + 1 AS BIGINT)) AS vocab_size
FROM s""",
    "training_curves": """
WITH m AS (SELECT event_type AS run, CAST(day(ts) AS BIGINT) AS epoch, count(*) AS n FROM events GROUP BY 1, 2),
l AS (SELECT run, epoch, CAST(n AS DOUBLE) / 1000.0 AS loss, CASE WHEN epoch % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS auc FROM m)
SELECT run, epoch, loss, auc, round(loss - lag(loss) OVER (PARTITION BY run ORDER BY epoch), 6) AS loss_change FROM l""",
}
ORACLE_SQL["results_file"] = f"""WITH by_lang AS ({ORACLE_SQL['ranking_by_group']})
SELECT 'Mortality' AS task, CASE lang WHEN 'en' THEN 'Unimodal' ELSE 'Multimodal' END AS model, roc_auc AS metric_1,
       average_precision AS metric_2, CAST(0 AS DOUBLE) AS metric_3
FROM by_lang WHERE lang IN ('en', 'de')"""
# The models' vectors hold the same exact weights.
ORACLE_SQL["note_vectors"] = ORACLE_SQL["vectorize_notes"]
