"""Best-fit packing by exact-complement hashing (operator 9).

Documents are tokenised and cut into pieces on the executors.  What a plan
needs of the pieces is how many there are of each length, at most 4096 counts
at any size of input; from these the driver plans kinds of sequences, each with
a number of times.  Pieces are numbered within their length and find their
place by that number.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghawk.llm.common import store

CAPACITY = 4096
END = 1
#: Pieces of a numbering group, about.
GROUP_ROWS = 1_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Words and parts that a task remembers.
REMEMBERED = 600_000
#: Bytes of the texts that are split and looked up at once, about.
TOGETHER = 8_000_000
#: By code point (256: all above): normal form and lower case are plain, letter by letter.
LATIN = np.isin(np.arange(257), [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, str]:
    """(where each text's parts between blanks begin and end, which of the
    different parts each is, the different parts joined by blanks)."""
    split = pc.ascii_split_whitespace(texts)
    parts = split.flatten().dictionary_encode()
    different = pa.ListArray.from_arrays(pa.array([0, len(parts.dictionary)], pa.int32()), parts.dictionary)
    after = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
    return after, parts.indices.to_numpy(), pc.binary_join(different, pa.scalar(" ", texts.type))[0].as_py()


def _bytes(data: pa.Buffer | None, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])


def _joined(values: pa.Array, take: np.ndarray, after: np.ndarray) -> pa.Array:
    """``values`` at ``take``, put together from one place of ``after`` to the next."""
    taken = values.take(pa.array(take))
    _, ends, data = taken.buffers()
    return _bytes(data, np.frombuffer(ends, np.int64, len(taken) + 1)[after])


class _Ids(dict):
    """Lower-case word of one kind of characters, or part that is no plain
    Latin-1 -> its number n; its ids are ``ids[starts[n]:starts[n + 1]]``.
    Words go to the tokenizer's model, other parts to the whole tokenizer."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_blank = Tokenizer(self.model)
        self.by_blank.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        kinds = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"   # the tokenizer's own pattern: fixed
        self.kinds = regex.compile(kinds)
        normal, split = ({} if x is None else json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        self.plain = [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and json.dumps(kinds) in json.dumps(split)
        shown = sorted({*range(33, 127), *range(161, 173), *range(174, 256)})      # byte-level alphabet: fixed, public
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = np.arange(256, dtype="<u2")
        self.alphabet[hidden] = 256 + np.arange(len(hidden))
        self.alphabet[ord(" ")] = ord(" ")      # parts the words
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)     # ids that end a word
        suffix = getattr(self.model, "end_of_word_suffix", None)
        if suffix:
            self.last[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[""] = 0
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.update(zip(keys, range(len(self), len(self) + len(keys))))
        self.starts = np.concatenate([self.starts, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, ids])

    def learn_words(self, words: list[str]) -> None:
        """New words, in one call of the tokenizer."""
        shown = " ".join(words)
        if not shown.isascii():
            shown = self.alphabet[np.frombuffer(shown.encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.by_blank.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):     # the model doesn't mark the ends of words
            each = [[t.id for t in self.model.tokenize(x)] for x in shown.split(" ")]
            ids, ends = np.array([*chain.from_iterable(each)], "<u4"), np.cumsum([len(x) for x in each])
        self.add(words, ids, ends)

    def learn_parts(self, parts: list[str]) -> None:
        each = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        self.add(parts, np.array([*chain.from_iterable(each)], "<u4"), np.cumsum([len(x) for x in each]))

    def of(self, whole: str) -> pa.Array:
        """Ids of different parts, little-endian; the parts come joined by blanks."""
        if len(self) > REMEMBERED:
            self.forget()
        spaced = [
            x if x.isalpha() else f"{x[:-1]} {x[-1]}" if x[-1:] in ".,!" and x[:-1].isalpha() else " ".join(self.kinds.findall(x))
            for x in whole.lower().split(" ")]
        others: set[str] = set()
        odd = self.beyond(whole) if self.plain else range(len(spaced))
        if odd:
            parts = whole.split(" ")
            for i in odd:
                spaced[i] = parts[i]
            others = {parts[i] for i in odd}
        after, which, words = _split(pa.array(spaced, pa.large_string()))
        words = words.split(" ")
        new = [x for x in words if x not in self]
        if some := [x for x in new if x not in others] if others else new:
            self.learn_words(some)
        if some := [x for x in new if x in others] if others else []:
            self.learn_parts(some)
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return _joined(_bytes(pa.py_buffer(self.ids), 4 * self.starts), number[which], after)

    @staticmethod
    def beyond(whole: str) -> list[int]:
        """Which of the parts aren't plain Latin-1, or may hold a special token."""
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        odd = ~LATIN[np.minimum(points, 256)]
        odd[:-1] |= (points[:-1] == ord("<")) & (points[1:] == ord("|"))
        return np.unique(np.searchsorted(np.flatnonzero(points == ord(" ")), np.flatnonzero(odd))).tolist()


def encode(texts: pa.Array, cache: _Ids) -> list[bytes]:
    """Ids of each text, little-endian; none of a null.  The tokenizer splits
    at white space before anything else, so different parts between blanks are
    encoded once for all these texts."""
    after, which, parts = _split(texts.cast(pa.large_string()).fill_null(""))
    return _joined(cache.of(parts), which, after).to_pylist()


def _together(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, some at a time."""
    group = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy()) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in pairwise(cuts) if b > a)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core
        cache, end = _Ids(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            texts = chain.from_iterable(encode(some, cache) for some in _together(batch.column(1)))
            for doc, ids in zip(batch.column(0).to_pylist(), texts):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for out, x in zip(rows, (doc, i, at // 4, len(part) // 4, zlib.crc32(part))):
                        out.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array(x, k) for x, k in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of sequences for ``counts`` of lengths: ([(length, times)], number).

    From the longest length down: a length whose gap equals one, two or three
    available lengths together consumes them, as often as all are available
    (sums of one and two are looked up by the complement, three by a longest
    part and the pair for the rest).  What is left is packed best-fit, longest
    first, many equal pieces and equal sequences at a time.
    """
    have = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        have[k] = n
    kinds: list[tuple[list[tuple[int, int]], int]] = []

    def consume(parts: list[int]) -> bool:
        need: dict[int, int] = {}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        times = min(int(have[p]) // c for p, c in need.items())
        if times < 1:
            return False
        for p, c in need.items():
            have[p] -= c * times
        kinds.append((sorted(need.items(), reverse=True), times))
        return True

    if have[capacity]:
        consume([capacity])

    def pair(total: int, most: int) -> list[list[int]]:
        """Available a >= b with a + b = total, a <= most; longest a first."""
        low = (total + 1) // 2
        a = np.arange(min(most, total - 1), low - 1, -1)
        a = a[(have[a] > 0) & (have[total - a] > 0)] if len(a) else a
        return [[int(x), total - int(x)] for x in a]

    for first in range(capacity - 1, 0, -1):
        gap = capacity - first
        if have[first] and have[gap]:
            consume([first, gap])
        if have[first]:
            for ab in pair(gap, gap):
                consume([first, *ab])
                if not have[first]:
                    break
        if have[first]:
            for a in np.flatnonzero(have[: min(first, gap - 2) + 1])[::-1].tolist() if gap > 2 else []:
                for bc in pair(gap - a, min(a, gap - a - 1)):
                    consume([first, a, *bc])
                    if not have[first] or not have[a]:
                        break
                if not have[first] or 3 * a < gap:
                    break

    # best fit: open sequences by gap, each kind with its number
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    gaps: list[int] = []        # those in use, sorted

    def put(gap: int, parts: list[tuple[int, int]], times: int) -> None:
        if times:
            if gap not in bins:
                bisect.insort(gaps, gap)
                bins[gap] = []
            bins[gap].append((parts, times))

    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, some = divmod(left, each)
                put(capacity - each * length, [(length, each)], full)
                put(capacity - some * length, [(length, some)], int(some > 0))
                break
            gap = gaps[at]
            parts, times = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[at]
            each = gap // length
            full = min(times, left // each)
            if full:
                put(gap - each * length, [*parts, (length, each)], full)
            left -= full * each
            times -= full
            if times and left:      # fewer than `each` are left
                put(gap - left * length, [*parts, (length, left)], 1)
                left, times = 0, times - 1
            put(gap, parts, times)
    return kinds + [x for group in bins.values() for x in group]


def slots(kinds: list[tuple[list[tuple[int, int]], int]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """length -> rows (first number, number of the first sequence, offset, times) in order of the first number."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for parts, number in kinds:
        offset = 0
        for length, times in parts:
            at = used.get(length, 0)
            out.setdefault(length, []).append((at, sequence, offset, times))
            used[length] = at + times * number
            offset += length * times
        sequence += number
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _place(where: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                s = where[int(x)]
                row = s[np.searchsorted(s[:, 0], number[mine], "right") - 1]
                past = number[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + past // row[:, 3]
                offset[mine] = row[:, 2] + past % row[:, 3] * x
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row
    for each piece of each input row.

    A document is its ids and the id 1 behind them; a longer one than
    ``capacity`` is cut into pieces of that length, the last may be shorter.
    Null and empty texts are the id 1 alone.  Rows that repeat an id, or have
    a null id, are packed each for itself.  Without rows there is no piece.
    Extra columns are ignored.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = store(texts.mapInArrow(_pieces(tokenizer_path, capacity), PIECES), "pk-pieces")
    counts = pieces.groupBy("length").count()
    counts = {r[0]: r[1] for r in counts.collect()}     # at most `capacity` rows
    where = slots(plan(counts, capacity), capacity)
    # numbers within a length: of the salted groups before, then within the group
    some = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.ceil(F.col("n") / GROUP_ROWS).cast("long")).cast("long")
    sizes = docs.sparkSession.createDataFrame(list(counts.items()), "length long, n long")
    salted = pieces.join(F.broadcast(sizes), "length").withColumn("salt", some).drop("n")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = store(salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "pk-groups")
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("inner", F.row_number().over(inner)).join(groups, ["length", "salt"]).withColumn("number", (F.col("base") + F.col("inner") - 1).cast("long"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        _place(where), f"{PIECES}, sequence_id long, offset long")
