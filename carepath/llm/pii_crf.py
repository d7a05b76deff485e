"""Personal data: fixed patterns for four kinds, and a linear-chain CRF over word shapes that adds spans.

The base patterns give emails, IPv4 addresses, card numbers (Luhn) and phone numbers, leftmost and non-overlapping per
kind; matches that fail a check are dropped and not retried. The CRF tags tokens (letter or digit runs, and single
other characters) with BIO labels for the same kinds and for secrets (long keys after an assignment). Its features are
the shapes of the token and its neighbours: character kinds, length range, and the character itself for punctuation.
It is trained on a small labelled table by gradient ascent on the log likelihood (forward-backward in numpy) and
decoded by Viterbi over many windows at once. A window is a stretch around tokens with a digit or one of ``@=+_/\\``;
elsewhere all tokens are plain words and punctuation, where the best path is ``O`` (checked by a test on whole texts).
A CRF span is added only where it overlaps no base span and passes its kind's check.

Defined results: a null text is empty and has no spans; a null doc_id stays null; repeated rows each get a row; offsets
are code points, the end exclusive; very long digit or letter runs take linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.llm.common import byte_slices, text_or_empty, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\W_]+|[^\s]")
_MARK = re.compile(r"[0-9@=+_/\\]+")
CONTEXT_CHARS = 60

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(x * 2 - 9 * (x > 4) for x in values[1::2])) % 10 == 0


def _is_ip(part: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in part.split("."))


def _is_card(part: str) -> bool:
    digits = part.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_phone(part: str) -> bool:
    return 9 <= len(_DIGIT.findall(part)) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, by kind and start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for kind, pattern, valid in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
            out.extend((kind, *m.span()) for m in pattern.finditer(text) if valid(m.group()))
    return out


# ------------------------------------------------------------------------------------------------ CRF


def _length_range(n: int) -> str:
    return str(n) if n < 5 else "5-7" if n < 8 else "8-12" if n < 13 else "13-19" if n < 20 else "20+"


def shape(token: str) -> str:
    """Character kinds and length range of a token; a punctuation character stands for itself."""
    if not token[0].isalnum():
        return token if token in "@=+_/\\.,:;-()\"'#" else "?"
    digits = sum(c.isdigit() for c in token)
    if digits == len(token):
        return "9" + _length_range(len(token))
    if digits:
        return "m" + _length_range(len(token))
    return "a" if token.islower() else "A"


def tokenize(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def _features(shapes: Sequence[str]) -> list[tuple[str, ...]]:
    padded = ["<", "<", *shapes, ">", ">"]
    return [
        (
            f"0{padded[i]}",
            f"-1{padded[i - 1]}",
            f"+1{padded[i + 1]}",
            f"-2{padded[i - 2]}",
            f"+2{padded[i + 2]}",
            f"-1 0{padded[i - 1]} {padded[i]}",
            f"0 +1{padded[i]} {padded[i + 1]}",
            f"-2 -1 0{padded[i - 2]} {padded[i - 1]} {padded[i]}",
            f"0 +1 +2{padded[i]} {padded[i + 1]} {padded[i + 2]}",
        )
        for i in range(2, len(padded) - 2)
    ]


@dataclass
class Crf:
    """Feature weights (features x labels) and transitions (labels x labels; a row is the earlier label)."""

    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, shapes: Sequence[str]) -> np.ndarray:
        rows = [[k for f in fs if (k := self.index.get(f)) is not None] for fs in _features(shapes)]
        return np.stack([self.weights[r].sum(axis=0) if r else np.zeros(len(LABELS)) for r in rows])


def _pad(items: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in items])
    out = np.zeros((len(items), size.max(initial=0), len(LABELS)))
    for i, x in enumerate(items):
        out[i, : len(x)] = x
    return out, size


def viterbi(emissions: Sequence[np.ndarray], transitions: np.ndarray) -> list[np.ndarray]:
    """Best label sequence of each window; all windows advance one token at a time."""
    if not emissions:
        return []
    e, size = _pad(emissions)
    windows, length, labels = e.shape
    score, back = e[:, 0].copy(), np.zeros((windows, length, labels), np.int8)
    for t in range(1, length):
        all_scores = score[:, :, None] + transitions[None]
        back[:, t] = all_scores.argmax(axis=1)
        step = all_scores.max(axis=1) + e[:, t]
        score = np.where((t < size)[:, None], step, score)
    path = np.zeros((windows, length), np.int64)
    now = score.argmax(axis=1)
    rows = np.arange(windows)
    for t in range(length - 1, -1, -1):
        path[:, t] = now
        now = np.where(t < size, back[rows, t, now], now) if t else now
    return [path[i, :n] for i, n in enumerate(size)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: Sequence[tuple[str, Sequence[Span]]], epochs: int = 120, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """Fit to (text, spans) rows by full-batch gradient ascent with Adam steps; deterministic."""
    data = []
    for text, spans in rows:
        tokens = tokenize(text)
        labels = np.zeros(len(tokens), np.int64)
        for kind, start, end in spans:
            inside = [i for i, (a, b) in enumerate(tokens) if a >= start and b <= end]
            for k, i in enumerate(inside):
                labels[i] = LABELS.index(("I-" if k else "B-") + kind)
        if tokens:
            data.append((_features([shape(text[a:b]) for a, b in tokens]), labels))
    index: dict[str, int] = {}
    for feats, _ in data:
        for fs in feats:
            for f in fs:
                index.setdefault(f, len(index))
    n, k = len(index), len(LABELS)
    size = np.array([len(y) for _, y in data])
    length, count = int(size.max(initial=1)), len(data)
    ids = np.zeros((count, length, 9), np.int64)
    gold = np.zeros((count, length), np.int64)
    mask = np.arange(length)[None] < size[:, None]
    for i, (feats, y) in enumerate(data):
        ids[i, : len(y)] = [[index[f] for f in fs] for fs in feats]
        gold[i, : len(y)] = y
    weights, transitions = np.zeros((n, k)), np.zeros((k, k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    both = mask[:, 1:]
    for epoch in range(1, epochs + 1):
        e = weights[ids].sum(axis=2) * mask[..., None]
        alpha, beta = np.zeros((count, length, k)), np.zeros((count, length, k))
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            step = _logsum(alpha[:, t - 1, :, None] + transitions[None], 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        z = _logsum(alpha[:, -1], 1)
        for t in range(length - 2, -1, -1):
            step = _logsum(transitions[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
        unary = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = (
            alpha[:, :-1, :, None] + transitions[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        )
        pair = np.exp(np.where(both[..., None, None], pair, -np.inf)).sum(axis=(0, 1))
        g_unary = np.eye(k)[gold] * mask[..., None] - unary
        g_weights = np.zeros_like(weights)
        np.add.at(g_weights, ids[mask], g_unary[mask][:, None, :])
        g_pair = np.zeros((k, k))
        np.add.at(g_pair, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        grads = (g_weights / count - decay * weights, (g_pair - pair) / count - decay * transitions)
        for j, (param, grad) in enumerate(zip((weights, transitions), grads)):
            m, v = moments[2 * j], moments[2 * j + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return Crf(index, weights, transitions)


# Sentences of the labelled table: {kind} is a value of the kind, other words stand for themselves. {lone} is a number
# that is no personal data, {code} a short mixed token.
TEMPLATES = (
    "Write to {email} before noon.",
    "the mail {email} was sent, and {email} was copied",
    "Server {ip} did not answer",
    "from {ip} to {ip}, port {lone}",
    "Paid with card {card} on the day",
    "numbers {card} {card} in the file",
    "Call {phone} or write",
    "phone: {phone}, room {lone}",
    "Call {local} today",
    "reach us at {local}.",
    'token = "{secret}" in the file',
    'key: "{secret}"',
    "password = {secret}",
    'api_key="{secret}"',
    "The year {lone} was a good one, with {lone} of {lone} done.",
    "Section {lone}. has version {version}. of the text",
    "License, Version {version} (the text)",
    "It cost {lone} - {lone} in total, {lone}/{lone} of it paid",
    "rows {lone}, {lone}, {lone} and {lone}",
    "x = {lone} + {lone}",
    "see a/b and c_d or e\\f, = and + and @ alone",
    "Article {code} or {code} of the book",
    "and/or the other, one_two = three",
    "The words of a plain line, with no number in it.",
    "In The Middle: Some Words; others (more) - and 'quotes' \"here\"!!",
    "some words. More words here, and words. few Words. words of the rest",
    "word. word. word. word. word, word, word, word. Word. Word, word. word",
    "as an. of it, in on, by. The. A. To be, or not. Of that. it was",
    "words\nMore. words. And more.\nWords. of words: words; words. more, Words",
    "an. an. an. an. Then then. Then then then. of, of, of, of. Of Of Of Of",
    "end. idiot\nwords of, the! words? words! words. Words words",
    "then " * 12 + "an. " * 24 + "End",
    "of, " * 24 + "then",
    "BY-NC {version} text*** with### signs$$$ and%%% more&&& signs | in | it",
)


def labelled_rows(repeats: int = 6, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """The small labelled table: every template filled ``repeats`` times with values of its kinds."""
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in rng.integers(0, 26, n))

    def value(kind: str) -> tuple[str, str | None]:
        if kind == "email":
            name = letters(rng.integers(3, 9)) + rng.choice(["", "." + digits(2), "_" + letters(4)])
            return f"{name}@{letters(5)}{rng.choice(['', digits(1)])}.{letters(7)}.com", "email"
        if kind == "ip":
            return ".".join(str(x) for x in rng.integers(1, 256, 4)), "ip"
        if kind == "card":
            body = "4" + digits(14)
            return body + next(d for d in "0123456789" if luhn(body + d)), "card"
        if kind == "phone":
            return f"+{rng.integers(1, 60)} ({digits(3)}) {digits(3)}-{digits(4)}", "phone"
        if kind == "local":
            return f"({digits(3)}) {digits(3)}-{digits(4)}", "phone"
        if kind == "secret":
            return "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, rng.integers(32, 48))), "secret"
        if kind == "version":
            return f"{rng.integers(1, 9)}.{rng.integers(0, 9)}", None
        if kind == "code":
            return letters(2) + digits(2), None
        return str(rng.integers(0, 10 ** int(rng.integers(1, 6)))), None

    rows = []
    for template in TEMPLATES * repeats:
        text, spans = "", []
        for piece in re.split(r"(\{\w+\})", template):
            kind = None
            if piece.startswith("{"):
                piece, kind = value(piece[1:-1])
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
        rows.append((text, spans))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """The default labelled table as (text, spans)."""
    kind = "text string, spans array<struct<kind:string,start:int,end:int>>"
    return spark.createDataFrame([(t, [tuple(s) for s in spans]) for t, spans in labelled_rows()], kind)


MAX_LABELLED = 10_000


def fit(table: DataFrame) -> Crf:
    """Train from (text, spans). At most MAX_LABELLED rows: the table is made by hand."""
    rows = table.limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled rows")
    return train(sorted((r.text, [tuple(s) for s in r.spans]) for r in rows))


_CHECKS = {
    "email": lambda x: "@" in x.strip("@"),
    "ip": lambda x: _IP.fullmatch(x) is not None and _is_ip(x),
    "card": lambda x: _CARD.fullmatch(x) is not None and _is_card(x),
    "phone": lambda x: 7 <= len(_DIGIT.findall(x)) <= 15 and _IP.fullmatch(x) is None,
    "secret": lambda x: len(x) >= 20,
}


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around characters that only non-plain tokens have, cut at white space."""
    out: list[list[int]] = []
    for m in _MARK.finditer(text):
        low, high = m.start() - CONTEXT_CHARS, m.end() + CONTEXT_CHARS
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    cut = []
    for low, high in out:
        low, high = max(0, low), min(len(text), high)
        while low > 0 and not text[low - 1].isspace() and (not cut or low > cut[-1][1]):
            low -= 1
        while high < len(text) and not text[high].isspace():
            high += 1
        if cut and low <= cut[-1][1]:
            cut[-1] = (cut[-1][0], max(high, cut[-1][1]))
        else:
            cut.append((low, high))
    return cut


def crf_spans(docs: Sequence[str], model: Crf, parts: Sequence[list[tuple[int, int]]] | None = None) -> list[list[Span]]:
    """Spans tagged by the CRF in each text, decoded over ``parts`` (default: the texts' windows)."""
    found: list[list[Span]] = [[] for _ in docs]
    jobs = []
    for d, text in enumerate(docs):
        for low, high in windows(text) if parts is None else parts[d]:
            tokens = tokenize(text, low, high)
            if tokens:
                jobs.append((d, tokens, [shape(text[a:b]) for a, b in tokens]))
    cache: dict[tuple[str, ...], np.ndarray] = {}
    jobs.sort(key=lambda j: len(j[1]))
    first = 0
    while first < len(jobs):
        last, longest = first + 1, len(jobs[first][1])
        while last < len(jobs) and len(jobs[last][1]) <= longest * 1.3 + 4 and (last - first) * len(jobs[last][1]) < 60_000:
            last += 1
        block = jobs[first:last]
        scores = []
        for _, _, shapes in block:
            key = tuple(shapes)
            if key not in cache:
                cache[key] = model.emissions(shapes)
            scores.append(cache[key])
        for (d, tokens, _), path in zip(block, viterbi(scores, model.transitions)):
            found[d].extend(_spans(tokens, path))
        cache.clear()
        first = last
    return [sorted(x, key=lambda s: (KINDS.index(s[0]), s[1])) for x in found]


def _spans(tokens: list[tuple[int, int]], path: np.ndarray) -> list[Span]:
    out: list[list] = []
    before = ""
    for i in np.flatnonzero(path):
        tag = LABELS[path[i]]
        kind = tag[2:]
        if tag[0] == "I" and out and before == kind and out[-1][3] == i - 1:
            out[-1][2], out[-1][3] = tokens[i][1], i
        else:
            out.append([kind, tokens[i][0], tokens[i][1], i])
        before = kind
    return [(k, a, b) for k, a, b, _ in out]


def all_spans(docs: Sequence[str], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; all spans are sorted by kind, then start."""
    base = [base_spans(t) for t in docs]
    out = []
    for text, own, tagged in zip(docs, base, crf_spans(docs, model)):
        more = [
            s
            for s in tagged
            if not any(s[1] < b[2] and b[1] < s[2] for b in own) and _CHECKS[s[0]](text[s[1] : s[2]])
        ]
        out.append((own, sorted(own + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else own))
    return out


def span_text(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: Iterable[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans by the first one's."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find(docs: DataFrame, model: Crf, keep: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """Kept columns, base and all spans (``kind:start:end`` joined by commas), counts of base kinds, masked text."""
    rows = docs.select(*keep, text_or_empty().alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    counts = [f"n_{k}" for k in BASE_KINDS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "_text"):
            docs = texts(batch, "_text")
            spans = all_spans(docs, model)
            kinds = [[s[0] for s in own] for own, _ in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    *(pa.array([k.count(kind) for k in kinds], pa.int64()) for kind in BASE_KINDS),
                    pa.array([span_text(own) for own, _ in spans], pa.string()),
                    pa.array([span_text(both) for _, both in spans], pa.string()),
                    pa.array([mask(t, both) if both else t for t, (_, both) in zip(docs, spans)], pa.string()),
                ],
                [*names, *counts, "base_spans", "spans", "masked"],
            )

    kinds = ", ".join(f"{c} long" for c in counts)
    return rows.mapInArrow(run, f"{schema}, {kinds}, base_spans string, spans string, masked string")


def redact(docs: DataFrame, model: Crf) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind; ``n_chars``, if there, is the new length. A null
    text stays null; all other columns pass unchanged."""
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            own = texts(batch)
            found = all_spans(own, model)
            new = [mask(t, both) if both else t for t, (_, both) in zip(own, found)]
            lost = batch.column(names.index("text")).is_null().to_pylist()
            columns = dict(zip(names, batch.columns))
            columns["text"] = pa.array([None if no else t for t, no in zip(new, lost)], pa.string())
            if "n_chars" in columns:
                kind = columns["n_chars"].type
                columns["n_chars"] = pa.array([None if no else len(t) for t, no in zip(new, lost)]).cast(kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(run, docs.schema)
