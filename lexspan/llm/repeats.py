"""Exact removal of long repeats by a prefix-free parse of the corpus.

A rolling hash of 8 bytes triggers phrase starts: the position with the smallest hash among those of a 200-byte
window is that window's trigger, so equal windows have equal triggers at equal places, no phrase is longer than a
window, and nothing depends on where a document begins. A document becomes a parse: for each trigger, and each side
of it that windows lean to, one phrase entry that stands for all consecutive windows with that trigger and side.

The dictionary groups entries by the bytes that all those windows must share (a key), then by all their bytes. An
entry whose bytes occur again is a repeat as a whole; an entry alone under its key can't hold any. Only entries that
share a key but not all bytes are compared window by window, in key order; those of a key with very many contexts are
dealt out by window. That order takes the place of the corpus
order that suffix arrays of dictionary and parse would give; it yields the same windows without global suffix ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, documents

LENGTH = 200
GRAM = 8
#: Windows lean right if the trigger is this far from their start or nearer.
LEAN = (LENGTH - GRAM) // 2
#: Bytes that all windows of one trigger and side share.
SHARED = LENGTH - LEAN
#: Rows of one key that a task holds at most.
HELD = 50_000
#: Different contexts of one key from which on they are dealt out window by window, so that no task has them all.
MANY = 1_000
_BLOCK = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def triggers(data: bytes) -> np.ndarray:
    """For each window of LENGTH bytes, the position of its trigger: the smallest hash, of equal ones the first."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, span = np.empty(n, np.int64), LENGTH - GRAM + 1
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        part = data[lo : hi + LENGTH - 1]
        g = np.ndarray((len(part) - GRAM + 1,), "<u8", part, 0, (1,)) * _A
        g ^= g >> np.uint64(29)
        g *= _B
        count = len(g)
        width = -(-count // span) * span
        h = np.full(width, np.uint64(0xFFFFFFFFFFFFFFFF))
        h[:count] = (g >> np.uint64(24) << np.uint64(24)) | np.arange(count, dtype=np.uint64)  # _BLOCK + LENGTH < 2**24
        rows = h.reshape(-1, span)
        first = np.minimum.accumulate(rows, axis=1).reshape(-1)
        last = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        m = hi - lo
        out[lo:hi] = (np.minimum(last[:m], first[span - 1 : span - 1 + m]) & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
    return out


def entries(data: bytes) -> tuple[np.ndarray, ...]:
    """key, bytes hash, first window, windows, distance of the trigger from the first window: one row per phrase entry."""
    at = triggers(data)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    right = np.arange(len(at)) >= at - LEAN
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(right.astype(np.int8)) != 0)) + 1
    start = np.concatenate(([0], cut))
    count = np.diff(np.concatenate((start, [len(at)])))
    t, side = at[start], right[start]
    key_from = np.where(side, t, t - LEAN)
    hashed = xxhash.xxh3_64_intdigest
    key = np.fromiter((hashed(data[a : a + SHARED], s) for a, s in zip(key_from.tolist(), side.tolist(), strict=True)), np.uint64, len(start))
    whole = np.fromiter((hashed(data[a : a + c + LENGTH - 1], r) for a, c, r in zip(start.tolist(), count.tolist(), (t - start).tolist(), strict=True)), np.uint64, len(start))
    return key.view(np.int64), whole.view(np.int64), start, count, t - start


# An entry's place in one long: first window (32 bits), windows (8), trigger distance (8), kind (4, SPLIT one of them)
FOUND, ENTRY, TWICE, SPLIT = 0, 1, 2, 8


def _pack(start: np.ndarray, count: np.ndarray, trigger: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return start << 20 | count << 12 | trigger << 4 | kind


def _unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return p >> 20, p >> 12 & 255, p >> 4 & 255, p & 15


def _rows(key: np.ndarray, whole: np.ndarray, ref: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, whole, ref, place)], ["key", "whole", "ref", "place"])


_PLACES = "key long, whole long, ref long, place long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, ref, text -> entries. Those that a batch has twice are found already; one of them goes on for the others."""
    for b in batches:
        parts, refs = [], []
        for ref, data in zip(b.column("ref").to_pylist(), byte_texts(b.column("text")), strict=True):
            e = entries(data)
            if len(e[0]):
                parts.append(e)
                refs.append(np.full(len(e[0]), ref, np.int64))
        if not parts:
            continue
        key, whole, start, count, trigger = (np.concatenate(x) for x in zip(*parts, strict=True))
        ref = np.concatenate(refs)
        order = np.lexsort((whole, key))
        key, whole, start, count, trigger, ref = (x[order] for x in (key, whole, start, count, trigger, ref))
        new = np.concatenate(([True], (np.diff(key) != 0) | (np.diff(whole) != 0)))
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(new)])))
        twice = np.repeat(size, size) > 1
        yield _rows(key[new], whole[new], ref[new], _pack(start[new], count[new], trigger[new], np.where(size > 1, TWICE, ENTRY)))
        if twice.any():  # dealt by their document
            yield _rows(ref[twice], whole[twice], ref[twice], _pack(start[twice], count[twice], trigger[twice], FOUND))


class _Groups:
    """Goes through rows sorted by key and bytes; says which entries are found, and which share a key but not all bytes."""

    def __init__(self) -> None:
        self.rest: list[np.ndarray] | None = None
        self.several = False  # the key of rest has had other bytes before

    def add(self, batch: list[np.ndarray] | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """-> rows found, and rows to compare (one per key and bytes; kind TWICE: found already, compare others with it)."""
        rows = batch if self.rest is None else self.rest if batch is None else [np.concatenate(x) for x in zip(self.rest, batch, strict=True)]
        none = [np.zeros(0, np.int64)] * 4
        if rows is None or not len(rows[0]):
            return none, none
        key, whole = rows[0], rows[1]
        upto = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
        if upto == 0 and len(key) > HELD:  # one key: all but its last bytes are settled
            upto = int(np.searchsorted(whole, whole[-1]))
            out = self._settle([x[:upto] for x in rows], True) if upto else (none, none)  # its contexts go window by window
            tail = [x[upto:] for x in rows]
            if len(tail[0]) > 1:
                found = [np.concatenate((a, b)) for a, b in zip(out[0], tail, strict=True)]
                tail = [x[:1].copy() for x in tail]
                tail[3] = (tail[3] & ~np.int64(15)) | TWICE
                out = (found, out[1])
            self.several |= upto > 0
            self.rest = tail
            return out
        out = self._settle([x[:upto] for x in rows], self.several) if upto else (none, none)
        self.several = self.several and not upto
        self.rest = [x[upto:] for x in rows]
        return out

    @staticmethod
    def _settle(rows: list[np.ndarray], first_several: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        key, whole, _, place = rows
        kind = place & 15
        passed = kind == FOUND
        new_key = np.concatenate(([True], np.diff(key) != 0))
        new = new_key | np.concatenate(([True], np.diff(whole) != 0)) | np.concatenate(([True], np.diff(passed.astype(np.int8)) != 0))
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        twice = (size > 1) | (np.bincount(group, kind == TWICE) > 0)
        of_key = np.cumsum(new_key) - 1
        distinct = np.bincount(of_key[new & ~passed], minlength=of_key[-1] + 1) > 1
        if first_several:
            distinct[0] = True
        found = passed | twice[group]
        to_compare = new & ~passed & distinct[of_key]
        compare = [x[to_compare] for x in rows]
        split = np.bincount(of_key[to_compare], minlength=of_key[-1] + 1) > MANY
        if first_several:  # a key that comes in parts is split throughout
            split[0] = True
        compare[3] = (compare[3] & ~np.int64(15)) | np.where(twice[group[to_compare]], TWICE, ENTRY) | np.where(split[of_key[to_compare]], SPLIT, 0)
        return [x[found] for x in rows], compare


def _grouped(want_found: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups()
        for b in _and_none(batches):
            rows = None if b is None else [b.column(c).to_numpy() for c in ("key", "whole", "ref", "place")]
            if rows is not None and not len(rows[0]):
                continue
            out = groups.add(rows)[0 if want_found else 1]
            if len(out[0]):
                yield _rows(*out)

    return run


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document and its entries to compare -> each entry with the bytes of its windows; entries of a key with very many
    contexts as single windows without bytes, whose key is the window's own."""
    for b in batches:
        out: list[tuple[int, int, int, int, bytes]] = []
        split: list[tuple[int, int, int, int, np.ndarray]] = []
        for ref, data, todo in zip(b.column("ref").to_pylist(), byte_texts(b.column("text")), b.column("todo").to_pylist(), strict=True):
            for e in todo:
                start, count = e["place"] >> 20, e["place"] >> 12 & 255
                context = data[start : start + count + LENGTH - 1]
                if e["place"] & SPLIT:
                    hashes = np.array(_window_hashes(context, count, e["place"] >> 4 & 255), np.uint64)
                    split.append((e["key"], e["whole"], ref, e["place"] & ~SPLIT, hashes))
                    if len(split) == 2_000:
                        yield from _with_none(_single(split))
                        split = []
                else:
                    out.append((e["key"], e["whole"], ref, e["place"], context))
        if split:
            yield from _with_none(_single(split))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["key", "whole", "ref", "place", "data"])


def _with_none(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Single windows with no bytes. Those that the batch has twice are found already; one of them goes on for the others."""
    key, whole, ref, place = (rows.column(c).to_numpy() for c in ("key", "whole", "ref", "place"))
    order = np.lexsort((whole, key))
    key, whole, ref, place = (x[order] for x in (key, whole, ref, place))
    new = np.concatenate(([True], (np.diff(key) != 0) | (np.diff(whole) != 0)))
    size = np.diff(np.concatenate((np.flatnonzero(new), [len(new)])))
    twice = np.repeat(size, size) > 1
    place = np.where(twice, place & ~np.int64(15) | TWICE, place)
    for part in (_rows(key[new], whole[new], ref[new], place[new]), _rows(ref[twice], whole[twice], ref[twice], place[twice] & ~np.int64(15) | FOUND)):
        if part.num_rows:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.binary())], [*part.schema.names, "data"])


def _single(rows: list[tuple[int, int, int, int, np.ndarray]]) -> pa.RecordBatch:
    """Entries with the hashes of their windows -> a row per window; key: of the window's hash and the entry's key."""
    hashes = np.concatenate([r[4] for r in rows])
    mixed = np.concatenate([r[4] ^ np.uint64(r[0] * int(_A) & (1 << 64) - 1) for r in rows])
    ref = np.concatenate([np.full(len(r[4]), r[2], np.int64) for r in rows])
    start = np.concatenate([(r[3] >> 20) + np.arange(len(r[4])) for r in rows])
    kind = np.concatenate([np.full(len(r[4]), r[3] & 15) for r in rows])
    return _rows(mixed.view(np.int64), hashes.view(np.int64), ref, _pack(start, np.ones(len(ref), np.int64), np.zeros(len(ref), np.int64), kind))


def _window_hashes(data: bytes, count: int, trigger: int) -> list[int]:
    """A hash of each window and of its trigger's distance."""
    hashed = xxhash.xxh3_64_intdigest
    return [hashed(data[i : i + LENGTH], trigger - i) for i in range(count)]


def _runs(ref: np.ndarray, at: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
    """Found windows, by document and position, as runs of at most 255."""
    order = np.lexsort((at, ref))
    ref, at = ref[order], at[order]
    ref, at = ref[alone[order]], at[alone[order]]
    if not len(ref):
        return _rows(*[np.zeros(0, np.int64)] * 4)
    new = np.concatenate(([True], (np.diff(ref) != 0) | (np.diff(at) != 1)))
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [len(at)])))
    more = [(s + k, min(255, n - k)) for s, n in zip(start.tolist(), size.tolist(), strict=True) for k in range(0, n, 255)]
    s, n = np.array(more, np.int64).T
    return _rows(ref[s], np.zeros(len(s), np.int64), ref[s], _pack(at[s], n, np.zeros(len(s), np.int64), FOUND))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with bytes, sorted by key and bytes -> runs of windows that another entry of the key has too. Single
    windows pass, for _windows."""
    held: list[tuple[int, int, int, int, np.ndarray]] = []
    key, last = None, None

    def settle() -> pa.RecordBatch:
        n = np.array([len(r[4]) for r in held])
        h = np.concatenate([r[4] for r in held])
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        ref = np.repeat(np.array([r[2] for r in held], np.int64), n)
        at = np.concatenate([(r[3] >> 20) + np.arange(len(r[4])) for r in held])
        todo = np.repeat(np.array([r[3] & 15 for r in held]) == ENTRY, n)
        return _runs(ref, at, (count[inverse] > 1) & todo)

    for b in _and_none(batches):
        if b is not None:
            whole_rows = b.column("data").is_valid()
            passing = b.filter(pc.invert(whole_rows))
            if passing.num_rows:
                yield passing.drop_columns(["data"])
            b = b.filter(whole_rows)
        rows = [] if b is None else zip(*(b.column(c).to_pylist() for c in ("key", "whole", "ref", "place", "data")), strict=True)
        for k, whole, ref, place, data in rows:
            if k != key:
                if held:
                    yield settle()
                held, key, last = [], k, None
            if whole == last:  # a repeated row of the table
                continue
            last = whole
            held.append((k, whole, ref, place, np.array(_window_hashes(data, place >> 12 & 255, place >> 4 & 255), np.uint64)))
        if b is None and held:
            yield settle()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows sorted by hash -> those found twice or more; found runs pass."""
    groups = _Groups()
    for b in _and_none(batches):
        rows = None if b is None else [b.column(c).to_numpy() for c in ("key", "whole", "ref", "place")]
        if rows is not None and not len(rows[0]):
            continue
        found = groups.add(rows)[0]
        if len(found[0]):
            yield _rows(*found)


def _removed(places: list[int], n: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the found windows cover."""
    out: list[tuple[int, int]] = []
    for start, count in sorted({(p >> 20, p >> 12 & 255) for p in places}):
        end = start + count + LENGTH - 1
        if end > n:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes left), n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs.

    Every byte inside a LENGTH-byte string that also starts anywhere else in the corpus is removed, judged on the
    input. Matches never cross rows. Null texts are empty; repeated rows and copies repeat each other; what is left
    may cut a character, so text is binary. Only doc_id and text are read.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("ref", F.xxhash64("doc_id", "text"))
    parsed = base.mapInArrow(_parse, _PLACES).repartition("key").sortWithinPartitions("key", "whole")
    found, compare = (parsed.mapInArrow(_grouped(x), _PLACES) for x in (True, False))
    dealt = base.repartition("ref")
    todo = compare.groupBy("ref").agg(F.collect_list(F.struct("key", "whole", "place")).alias("todo")).withColumnRenamed("ref", "ref_")
    with_bytes = dealt.join(todo, F.col("ref") == F.col("ref_")).mapInArrow(_with_bytes, f"{_PLACES}, data binary")
    close = with_bytes.repartition("key").sortWithinPartitions("key", "whole").mapInArrow(_compared, _PLACES)
    close = close.repartition("key").sortWithinPartitions("key", "whole").mapInArrow(_windows, _PLACES)
    runs = found.select("ref", "place").unionByName(close.select("ref", "place")).groupBy("ref").agg(F.collect_set("place").alias("places")).withColumnRenamed("ref", "ref_")
    rows = dealt.join(runs, F.col("ref") == F.col("ref_"), "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, size, gone, spans = [], [], [], []
            for data, places in zip(byte_texts(b.column("text")), b.column("places").to_pylist(), strict=True):
                cut = _removed(places or [], len(data))
                at, parts = 0, []
                for a, z in cut:
                    parts.append(data[at:a])
                    at = z
                kept.append(b"".join([*parts, data[at:]]))
                size.append(len(data))
                gone.append(sum(z - a for a, z in cut))
                spans.append(len(cut))
            digest = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(digest, pa.string())], ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every document; nulls, empty texts and repeated rows as in without_repeats()."""
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
