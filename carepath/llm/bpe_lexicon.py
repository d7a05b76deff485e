"""BPE encoding and decoding with a minimal acyclic transducer for frequent words.

The vocabulary is read from a tokenizer file (byte-level BPE whose words end in a suffix; special strings in a text
become their ids). A batch's texts are normalised and cut into words by character class, in arrays of bytes; Arrow makes
the words distinct. A word is looked up in the lexicon: the most frequent words of the corpus, counted over all
documents, compiled with their ids into a minimal acyclic automaton (equal suffix states are shared) whose arcs carry
numbers that add up to the word's place in the id table. Its bytes are memory-mapped in each task. Other words are
merged exactly, by rank and then from the left, all words of a batch together; very long ones with a heap, in n log n
steps. Results never depend on the lexicon.

Decoding joins the tokens with spaces, as the library does for a file without a decoder.

Texts with other characters than SETTLED ones (Latin, Greek and Cyrillic letters without combining marks; the tests
compare each with the library) or with special strings are normalised and cut by the library's own parts.

Defined results: a null text is empty and has no ids; a null id list decodes to the empty text; a null doc_id stays
null; repeated rows each get a row; an empty table gives no rows; ids outside the vocabulary are left out on decoding.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import HashLookup, byte_slices, lists, stage, text_or_empty

LEXICON_WORDS = 150_000
# Bytes of text encoded together: the more, the fewer distinct pieces are met again.
ENCODE_BYTES = 2_000_000
HEAP_FROM = 48
# Words up to this many bytes are merged together, longer ones one by one.
WIDE = 32
NO_MERGE = 1 << 62
# Characters whose normal form, lower case and class need no library: see the docstring.
ODD = (
    r"[^\x00-\x{12f}\x{131}-\x{239}\x{23b}-\x{23d}\x{23f}-\x{2ff}\x{370}-\x{373}\x{375}-\x{377}\x{37b}-\x{37d}\x{384}-\x{386}\x{388}-\x{38a}"
    r"\x{38c}\x{38e}-\x{3a1}\x{3a3}-\x{482}\x{48a}-\x{52f}]"
)
# Fixed value: the pattern of words that cut_words implements.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, OTHER, LEAD = range(5)


def _class(code: int) -> int:
    kind = unicodedata.category(chr(code))[0]
    return SPACE if chr(code) in " \t\n\x0b\x0c\r\x85\xa0" else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


CODE_CLASS = np.array([_class(c) for c in range(0x530)], np.uint8)
BYTE_CLASS = np.concatenate([CODE_CLASS[:128], np.full(128, LEAD, np.uint8)])


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, where each text's words start and end) of lower-case texts of settled characters.

    A word starts where the character class changes; every number is a word; white space is dropped. An apostrophe that
    starts a run of other characters takes a contraction's letters with it, and the next letter starts a word.
    """
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if len(texts) else 0
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first : first + ends[-1]]
    kind = BYTE_CLASS[data]
    inner = np.zeros(len(data), bool)
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = CODE_CLASS[((data[lead] & 31).astype(np.int64) << 6) | (data[lead + 1] & 63)]
    inner[lead + 1] = True
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[ends[:-1][size > 0]] = True
    start = (kind != SPACE) & ~inner & (new | (kind == NUMBER))
    quote = np.flatnonzero((data == 39) & start)
    if len(quote):
        limit = ends[np.searchsorted(ends, quote, "right")]
        one, two = (np.where(quote + k < limit, data[np.minimum(quote + k, len(data) - 1)], 0) for k in (1, 2))
        letters = np.isin(one, list(b"stmd")) * 1
        letters += 2 * (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        hit = letters > 0
        quote, after, limit = quote[hit], (quote + 1 + letters)[hit], limit[hit]
        start[quote + 1] = False
        after = after[after < limit]
        start[after[kind[after] == LETTER]] = True
    keep = kind != SPACE
    place = np.cumsum(keep)
    at = np.flatnonzero(start)
    offsets = np.append(place[at] - 1, place[-1] if len(place) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[keep]))
    return words, np.searchsorted(at, ends)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] numbers), start[1], ...: the places of ragged rows."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Bpe:
    """A vocabulary with exact merges. ``source`` is the text of the tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, self.source = spec["model"], source
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if model["type"] != "BPE" or any(t[f] for t in spec["added_tokens"] for f in flags):
            raise ValueError("not a tokenizer file of the supported form")
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + suffix] for x in letters]
        # left << 32 | right -> rank << 32 | merged: numbers compare and hash faster than pairs.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens: list[str | None] = [None] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        names = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["pattern"]["Regex"] != WORD_RULE:
            raise ValueError("the file cuts words by another pattern")
        self._library = None
        self._pairs: HashLookup | None = None

    def library_words(self, text: str) -> list[str]:
        """Normalised words of any text, special strings as words of their own, by the library's parts."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source)
        out: list[str] = []
        for x in self.special_pattern.split(text) if self.special_pattern else [text]:
            if x in self.special:
                out.append(x)
            else:
                norm = self._library.normalizer.normalize_str(x)
                out += [norm[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word by exact merges: the lowest rank first, the leftmost of equals."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > HEAP_FROM:
            return self._merge_long(ids)
        get, none = self.merges.get, NO_MERGE
        found = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(found):
                found[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def merge_many(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words given as places in an array of bytes. Words of similar length are merged
        together, each round merging every word's best pair."""
        if self._pairs is None:
            self._pairs = HashLookup(np.fromiter(self.merges.keys(), np.int64, len(self.merges)))
            self._found = np.fromiter(self.merges.values(), np.int64, len(self.merges))
            self._inner, self._last = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        count, done = np.zeros(len(size), np.int64), []
        for i in np.flatnonzero(size > WIDE).tolist():
            ids = np.array(self.merge(raw[start[i] : start[i] + size[i]].tobytes()), np.uint32)
            count[i] = len(ids)
            done.append((np.array([i]), ids))
        low = 0
        for high in (6, 10, 16, WIDE):
            rows = np.flatnonzero((size > low) & (size <= high))
            for lo in range(0, len(rows), 8192):
                own = rows[lo : lo + 8192]
                ids, count[own] = self._merge_block(raw, start[own], size[own], high)
                done.append((own, ids))
            low = high
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for own, ids in done:
            out[spread(first[own], count[own])] = ids
        return out, count

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        place = self._pairs.find((left << 32 | right).ravel())
        return np.where(place >= 0, self._found[place], NO_MERGE).reshape(left.shape)

    def _merge_block(
        self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int
    ) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(start), size.copy()
        at = np.arange(width)[None]
        there = at < size[:, None]
        raw = np.zeros((n, width), np.uint8)
        raw[there] = data[spread(start, size)]
        ids = np.where(there, self._inner[raw], 0)
        ids[np.arange(n), size - 1] = self._last[raw[np.arange(n), size - 1]]
        rank = np.full((n, width), NO_MERGE)
        rank[:, :-1] = np.where(there[:, 1:], self._rank(ids[:, :-1], ids[:, 1:]), NO_MERGE)
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(axis=1)
            found = rank[live, best]
            some = found != NO_MERGE
            live, best, found = live[some], best[some], found[some]
            if not len(live):
                break
            keep = np.minimum(at + (at > best[:, None]), width - 1)
            own = np.take_along_axis(ids[live], keep, axis=1)
            own[np.arange(len(live)), best] = found & 0xFFFFFFFF
            ranks = np.take_along_axis(rank[live], np.minimum(at + (at >= best[:, None]), width - 1), axis=1)
            ranks[:, -1] = NO_MERGE
            size[live] -= 1
            for p in (best - 1, best):
                here = np.flatnonzero((p >= 0) & (p + 1 < size[live]))
                ranks[here, p[here]] = self._rank(own[here, p[here]], own[here, p[here] + 1])
            here = np.flatnonzero(best + 1 >= size[live])
            ranks[here, best[here]] = NO_MERGE
            ids[live], rank[live] = own, ranks
        return ids[at < size[:, None]].astype(np.uint32), size

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(found, i, p) for i in range(n - 1) if (found := merges.get(p := ids[i] << 32 | ids[i + 1])) is not None]
        # The rank leads the number, the place breaks ties from the left.
        heap = [(found >> 32, i, found & 0xFFFFFFFF, p) for found, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := merges.get(p := ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (found >> 32, a, found & 0xFFFFFFFF, p))
        return [x for x, ok in zip(ids, alive) if ok]


# ------------------------------------------------------------------------------------------- lexicon


def compile_lexicon(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The minimal acyclic transducer of the words, as bytes for ``Lexicon``.

    Words are added in order; a state whose words are complete is replaced by an equal state built before, so equal
    suffixes are stored once. An arc's number is how many words come before it in its state.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def close(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    order = sorted(entries)
    open_states: list[list] = [[False, []]]
    before = b""
    for word in order:
        common = len(os.path.commonprefix([before, word]))
        for depth in range(len(before), common, -1):
            final, arcs = open_states.pop()
            open_states[-1][1].append((before[depth - 1], close(final, arcs)))
        open_states.extend([False, []] for _ in range(len(word) - common))
        open_states[-1][0] = True
        before = word
    for depth in range(len(before), 0, -1):
        final, arcs = open_states.pop()
        open_states[-1][1].append((before[depth - 1], close(final, arcs)))
    root = close(*open_states[0])
    size = [0] * len(states)
    first, labels, targets, numbers = [0], bytearray(), [], []
    for s, (final, arcs) in enumerate(states):
        size[s] = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            numbers.append(size[s])
            size[s] += size[target]
        first.append(len(targets))
    flat = [i for w in order for i in entries[w]]
    ends = np.cumsum([0, *(len(entries[w]) for w in order)])
    arrays = [
        np.array([root, len(states), len(targets), len(order), len(flat)]),
        np.array(first),
        np.array([int(f) for f, _ in states]),
        np.array(targets),
        np.array(numbers),
        ends,
        np.array(flat),
    ]
    return b"".join(a.astype("<i4").tobytes() for a in arrays) + bytes(labels)


class Lexicon:
    """A compiled transducer, memory-mapped. All words of a call walk it together, one byte at a time."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data or b"\0")
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        ints = np.frombuffer(self.map, "<i4", len(data) // 4)
        self.root, states, arcs, words, flat = ints[:5].tolist()
        cut = np.cumsum([5, states + 1, states, arcs, arcs, words + 1, flat]).tolist()
        self.first, self.final, self.target, self.number, self.ends, self.ids = (
            ints[a:b] for a, b in zip(cut[:-1], cut[1:])
        )
        labels = np.frombuffer(self.map, np.uint8, arcs, 4 * cut[-1]).astype(np.int64)
        source = np.repeat(np.arange(states), np.diff(self.first))
        self.arcs = HashLookup(source << 8 | labels)

    def places(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each word's place in the id table, -1 for a word that is not there: the numbers on its path added up."""
        state, place = np.full(len(size), self.root, np.int64), np.zeros(len(size), np.int64)
        live = np.flatnonzero(size > 0)
        for k in range(int(size.max(initial=0))):
            arc = self.arcs.find(state[live] << 8 | raw[start[live] + k])
            place[live[arc < 0]] = -1
            live, arc = live[arc >= 0], arc[arc >= 0]
            place[live] += self.number[arc]
            state[live] = self.target[arc]
            live = live[size[live] > k + 1]
            if not len(live):
                break
        place[(place >= 0) & (self.final[state] == 0)] = -1
        return place


class Encoder:
    """Texts to ids, a batch at a time. Merged words are remembered, ``remember`` of them at most: a batch that would
    go beyond that starts over with its own."""

    def __init__(self, bpe: Bpe, lexicon: bytes = b"", remember: int = 0):
        self.bpe = bpe
        self.remember = remember
        self.known = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.special = pa.array(sorted(bpe.special), pa.string())

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of distinct words: from the lexicon, or merged."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        place = self.lexicon.places(raw, start, size) if self.lexicon else np.full(len(size), -1)
        seen, unseen = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        merged, count = self.bpe.merge_many(raw, start[unseen], size[unseen])
        each = np.zeros(len(size), np.int64)
        each[unseen] = count
        if len(seen):
            low = self.lexicon.ends[place[seen]].astype(np.int64)
            each[seen] = self.lexicon.ends[place[seen] + 1] - low
        first = np.cumsum(each) - each
        out = np.zeros(int(each.sum()), np.uint32)
        out[spread(first[unseen], count)] = merged
        if len(seen):
            out[spread(first[seen], each[seen])] = self.lexicon.ids[spread(low, each[seen])]
        return out, each

    def remembered_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``word_ids``; words merged for an earlier batch are looked up."""
        known, flat, size = self.known
        place = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = words.filter(pa.array(place < 0))
        more, count = self.word_ids(fresh)
        place[place < 0] = len(known) + np.arange(len(fresh))
        flat, size = np.concatenate([flat, more]), np.concatenate([size, count])
        each = size[place]
        out = flat[spread((np.cumsum(size) - size)[place], each)]
        if len(known) + len(fresh) <= self.remember:
            self.known = pa.concat_arrays([known, fresh]), flat, size
        elif len(words) <= self.remember:
            self.known = pa.concat_arrays([words]), out, each
        return out, each

    def _ids(self, words: pa.Array, ends: np.ndarray, special: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts given by their words."""
        coded = words.dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        flat, size = self.remembered_ids(distinct) if self.remember else self.word_ids(distinct)
        first = np.cumsum(size) - size
        if special:
            names = np.flatnonzero(pc.is_in(distinct, self.special).to_numpy(zero_copy_only=False))
            ids = [self.bpe.special[distinct[i].as_py()] for i in names.tolist()]
            first[names], size[names] = len(flat) + np.arange(len(ids)), 1
            flat = np.concatenate([flat, np.array(ids, np.uint32)])
        each = size[at]
        return flat[spread(first[at], each)], np.concatenate([[0], np.cumsum(each)])[ends]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts of a string array; a null text has no ids."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, ODD)
        for name in self.bpe.special:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = texts if not odd.any() else texts.filter(pa.array(~odd))
        ids, ends = self._ids(*cut_words(pc.utf8_lower(plain)))
        if not odd.any():
            return ids, ends
        words = [self.bpe.library_words(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        cut = np.cumsum([0, *map(len, words)])
        more, more_ends = self._ids(pa.array(list(chain.from_iterable(words)), pa.string()), cut, True)
        size = np.zeros(len(odd), np.int64)
        size[~odd], size[odd] = np.diff(ends), np.diff(more_ends)
        offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(offsets[-1], np.uint32)
        out[spread(offsets[:-1][~odd], size[~odd])] = ids
        out[spread(offsets[:-1][odd], size[odd])] = more
        return out, offsets

    def encode(self, text: str) -> list[int]:
        return self.encode_array(pa.array([text], pa.string()))[0].tolist()


_ENCODERS: dict[tuple[int, int, int], Encoder] = {}


def shared_encoder(source: str, lexicon: bytes, remember: int = 0) -> Encoder:
    """One encoder per Python worker and lexicon, for all tasks of the worker."""
    key = (hash(source), hash(lexicon), remember)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Bpe(source), lexicon, remember)
    return _ENCODERS[key]


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS) -> list[str]:
    """At most ``limit`` words that occur most often in all documents (ties at the cut are left out together).

    Counting is a Spark aggregation; a histogram over about 200 count ranges gives the cut, so no more than ``limit``
    words reach the driver.
    """
    words = docs.select(F.explode(F.split(F.lower(text_or_empty("text")), "[^\\p{L}]+")).alias("word"))
    counts = words.groupBy("word").count().where((F.col("count") >= 2) & (F.length("word").between(2, 40)))
    counts = stage(counts.withColumn("range", F.floor(F.log2("count") * 4).cast("int")))
    ranges = sorted(counts.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    total, cut = 0, None
    for r in ranges:
        total += r.n
        if total > limit:
            break
        cut = r.range
    return [] if cut is None else [r.word for r in counts.where(F.col("range") >= cut).select("word").collect()]


def build_lexicon(words: Iterable[str], bpe: Bpe) -> bytes:
    """Compile the words with their ids; a frequent word that the vocabulary splits adds its parts."""
    parts = sorted({p for w in words for p in bpe.library_words(w)} - set(bpe.special))
    if not parts:
        return b""
    flat, size = Encoder(bpe).word_ids(pa.array(parts, pa.string()))
    ends = np.cumsum(size).tolist()
    flat = flat.tolist()
    return compile_lexicon({p.encode(): flat[a:b] for p, a, b in zip(parts, [0, *ends[:-1]], ends)})


def _id_list(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


class Decoder:
    """Ids to text: the tokens joined by spaces, ids outside the vocabulary left out."""

    def __init__(self, bpe: Bpe):
        self.tokens = pa.array([t or "" for t in bpe.tokens], pa.string())
        self.known = np.array([t is not None for t in bpe.tokens])

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        good = (flat >= 0) & (flat < len(self.known))
        good &= self.known[np.where(good, flat, 0)]
        ends = np.concatenate([[0], np.cumsum(good)])[ends]
        tokens = self.tokens.take(pa.array(flat[good]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens), " ")


def _source(path: str | None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def _typed(fields) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def encode(
    docs: DataFrame,
    path: str | None = None,
    lexicon: bytes | None = None,
    keep: Sequence[str | Column] = ("doc_id",),
    decoded: bool = False,
) -> DataFrame:
    """Kept columns and ``ids`` of every text. With ``decoded``, also the text that ``decode`` gives for these ids,
    from the same task. Vocabulary and lexicon (bounded by LEXICON_WORDS) travel with the tasks."""
    source = _source(path)
    data = build_lexicon(frequent_words(docs), Bpe(source)) if lexicon is None else lexicon
    rows = docs.select(*keep, text_or_empty().alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(source, data)
        decoder = Decoder(encoder.bpe)
        for batch in byte_slices(batches, "_text", ENCODE_BYTES):
            ids = _id_list(*encoder.encode_array(batch.column(batch.schema.get_field_index("_text"))))
            columns, own = [*(batch.column(n) for n in names), ids], [*names, "ids"]
            if decoded:
                back = decoder.decode(ids.values.to_numpy(), ids.offsets.to_numpy())
                columns, own = [*columns, back], [*own, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, own)

    return rows.mapInArrow(run, f"{_typed(fields)}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of ``ids``."""
    source, names = _source(path), encoded.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Bpe(source))
        for batch in byte_slices(batches, "ids"):
            back = decoder.decode(*lists(batch, "ids"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), back], [*names, "decoded"])

    return encoded.mapInArrow(run, f"{_typed(encoded.schema.fields)}, decoded string")
