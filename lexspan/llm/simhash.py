"""SimHash near-duplicates with pigeonring filtering.

The 64 bits are cut into M segments on a ring. If two fingerprints differ in at most T bits, some segment starts a
chain whose first n segments together differ in at most n * T / M bits, for every n from 1 to M. With M = 8 and T = 2
the first three segments of that chain must agree: they are the blocking key. The next four together differ in one bit at
most, so of two halves of them one agrees: larger groups are split by that, and once more. The chain's prefixes prune
candidates, and the full Hamming distance decides. grouped() finds documents of a given similarity by a longer ring of
SimHash bits, whose chains start at an equal box; the full Hamming distance follows, then the exact similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, documents, slices, staged
from .components import components

BITS = 64
#: A larger blocking group is split by further segments of its chain; see links(). For grouped() see BLOCK.
GROUP = 2_048

def _hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than a shingle are one sequence."""
    n = len(words)
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([hashed(joined, seed)], np.uint64)
    if shingle == 1:
        return np.fromiter((hashed(w, seed) for w in words), np.uint64, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = n - shingle + 1
    return np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[:count].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, count)


def _majority(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of h."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65_536):  # bounds the unpacked bits
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half the shingles' XXH64; no words: 0."""
    words = text.lower().split()
    return _majority(_hashes(words, shingle, seed)) if words else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), one row per row of docs.

    A-Z are lower-cased, words are maximal runs without ASCII white space; null and wordless texts give 0, shorter
    texts than a shingle one hash of the whole sequence. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(x, shingle) for x in byte_texts(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


M, T = 8, 2
WIDTH = BITS // M
#: Segments that must agree: the longest chain prefix whose budget is below one bit.
EXACT = (M - 1) // T


def chain_holds(diff: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether every prefix of the chain from segment start stays within its proportional budget."""
    by = (start * WIDTH).astype(np.uint64)
    turned = diff >> by | diff << (np.uint64(BITS) - by) % np.uint64(BITS)
    good = np.ones(diff.shape, bool)
    for n in range(1, M + 1):
        good &= np.bitwise_count(turned << np.uint64(BITS - n * WIDTH)) * M <= n * T
    return good


def near(diff: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Indices of the differences that pass the chain filter and then the full Hamming check."""
    at = np.flatnonzero(chain_holds(diff, start))
    return at[np.bitwise_count(diff[at]) <= T]


#: Bits of a key: the chain's start, the segments that agree, and for split groups twice which half and its segments.
_START, _FIRST, _HALF, _QUARTER = 3, 3 + WIDTH * EXACT, 2 + 2 * WIDTH, 2 + WIDTH


def _segment(k: int) -> F.Column:
    """The k-th segment of a row's chain; fp and key (whose lowest bits are the chain's start)."""
    by = f"CAST({WIDTH} * (key & {M - 1}) AS INT)"
    turned = F.expr(f"shiftrightunsigned(fp, {by}) | shiftleft(fp, {BITS} - {by})")
    return F.shiftrightunsigned(turned, k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _keys(nodes: DataFrame) -> DataFrame:
    """fp -> one row per ring position: key holds the position and the segments that must agree there."""
    k = nodes.select("fp", F.explode(F.array(*(F.lit(i).cast("long") for i in range(M)))).alias("key"))
    key = F.col("key")
    for j in range(EXACT):
        key = key.bitwiseOR(F.shiftleft(_segment(j), _START + j * WIDTH))
    return k.select("fp", key.alias("key"))


def _halves(keys: DataFrame) -> DataFrame:
    """Rows of groups that are too large, once per half of the chain's next four segments, with that half in the key."""
    def half(tag: int, k: int) -> F.Column:
        return F.col("key").bitwiseOR(F.shiftleft(F.lit(tag).cast("long").bitwiseOR(F.shiftleft(_segment(k), 2)).bitwiseOR(F.shiftleft(_segment(k + 1), 2 + WIDTH)), _FIRST))

    return keys.select("fp", F.explode(F.array(half(1, EXACT), half(2, EXACT + 2))).alias("key"))


def _quarters(keys: DataFrame) -> DataFrame:
    """The same for groups of a half: of the other half's two segments one agrees."""
    first = F.shiftrightunsigned("key", _FIRST).bitwiseAND(F.lit(3)) == 1  # the first half agrees, so the second is split

    def quarter(tag: int, k: int) -> F.Column:
        segment = F.when(first, _segment(EXACT + 2 + k)).otherwise(_segment(EXACT + k))
        return F.col("key").bitwiseOR(F.shiftleft(F.lit(tag).cast("long").bitwiseOR(F.shiftleft(segment, 2)), _FIRST + _HALF))

    return keys.select("fp", F.explode(F.array(quarter(1, 0), quarter(2, 1))).alias("key"))


SMALL = 64


def spanning(group: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links of a forest that joins all that links join within the groups, whose rows lie together.

    ``linked`` gets two arrays of rows and says at which places the two rows are linked. What is joined already is not
    tested again, so a group of like rows costs far less than its pairs.
    """
    n = len(group)
    size = np.bincount(group)[group]
    root = np.arange(n)
    members: dict[int, list[int]] = {}
    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        x, y = int(root[i]), int(root[j])
        if x == y:
            return
        a, b = members.pop(x, [x]), members.pop(y, [y])
        if len(a) < len(b):
            a, b, x = b, a, y
        root[b] = x
        a.extend(b)
        members[x] = a
        out.append((i, j))

    for step in range(1, SMALL):  # small groups: all rows with the row that is ``step`` further on, at once
        i = np.flatnonzero((group[:-step] == group[step:]) & (size[:-step] <= SMALL)) if step < n else np.zeros(0, int)
        if not len(i):
            break
        i = i[root[i] != root[i + step]]
        for k in i[linked(i, i + step)].tolist():
            join(k, k + step)
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    for lo in firsts[size[firsts] > SMALL].tolist():
        hi = lo + int(size[lo])
        for i in range(lo, hi - 1):
            other = i + 1 + np.flatnonzero(root[i + 1 : hi] != root[i])
            if len(other):
                for j in other[linked(np.full(len(other), i), other)].tolist():
                    join(i, j)
    return out


def stars(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of a forest -> links that join the same rows, each row with the first of its tree."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            above[x] = x = above.get(above[x], above[x])
        return x

    for i, j in found:
        x, y = top(i), top(j)
        if x != y:
            above[max(x, y)] = min(x, y)
    return [(top(x), x) for x in above]


def _by_key(link: Callable[[dict[str, np.ndarray]], list[tuple[int, int]]]) -> Callable:
    """For mapInArrow over rows (key, id, ...) sorted by key, each key whole in one partition -> links (a, b) of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def links_of(t: pa.Table) -> pa.RecordBatch:
            col = {c: t.column(c).to_numpy() for c in t.column_names}
            col["group"] = np.concatenate(([0], np.cumsum(np.diff(col["key"]) != 0)))
            i, j = np.array(link(col), np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(col["id"][i]), pa.array(col["id"][j])], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            if not t.num_rows:
                continue
            keys = t.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if whole:
                yield links_of(t.slice(0, whole))
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            yield links_of(rest)

    return run


def _link_fingerprints(col: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    fp, start = col["id"].view(np.uint64), col["key"] & (M - 1)
    return spanning(col["group"], lambda i, j: near(fp[i] ^ fp[j], start[i]))


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Distinct fp -> (a, b) whose components are those of all links at Hamming distance T or less.

    A blocking group of more than ``group`` fingerprints is split by a further half of its chain, and such a group again
    by a segment: every link of its chain is in one of the parts. After that 48 bits agree, so that no part has more than
    2 ** 16 fingerprints.
    """
    keys, ready = _keys(nodes), None
    for split in (_halves, _quarters, None):
        if split is None:
            parts = keys
        else:
            large = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("key", F.lit(True).alias("large"))
            marked = keys.join(large, "key", "left")
            parts, keys = marked.where("large IS NULL").select("fp", "key"), split(marked.where("large").select("fp", "key"))
        ready = parts if ready is None else ready.unionByName(parts)
    ready = ready.select("key", F.col("fp").alias("id")).repartition("key").sortWithinPartitions("key")
    return ready.mapInArrow(_by_key(_link_fingerprints), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id: one row per row of docs; component_id is the smallest doc_id reachable by links.

    Equal fingerprints are one node (pre-aggregated), so copies never form pairs. Null doc_ids take part but never
    become a component_id unless the component has no other. Empty texts have fingerprint 0 and link like others.
    """
    fps = staged(fingerprints(docs, shingle), "simhash-fp")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes.select("fp"), group))
    member = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = member.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = member.join(of_root, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


#: The ring of grouped(): BOXES boxes of BOX bits, WORDS SimHash fingerprints of BITS bits one after the other.
BOX, WORDS = 16, 24
BOXES = BITS * WORDS // BOX
#: Boxes of a chain, after its first, that are tested before two rings are candidates.
AHEAD = 2 * BITS // BOX
#: Chains with the first starts go ahead: what they join is one for the others, so that a large group doesn't make links by every box.
EARLY = 16
_MASK, _TIMES = np.random.default_rng(7).integers(0, 1 << 63, (2, WORDS), np.uint64, endpoint=True) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Rows of one hash, or of WORDS hashes -> rows of WORDS hashes, each made in its own way."""
    x = (h ^ _MASK) * _TIMES
    x ^= x >> np.uint64(32)
    x *= _TIMES[::-1]
    return x ^ x >> np.uint64(29)


def ring(text: bytes, shingle: int = 5) -> np.ndarray:
    """WORDS SimHash fingerprints of the set of ``shingle``-word shingles; no words: zeros.

    Bit i of each is 1 if it is set in over half of that fingerprint's hashes. One of the 255 shingles of the smallest
    hashes, another for each fingerprint, counts once more if the shingles are even in number and twice more if odd:
    without that, many bits of a few shingles would be ties and similar short texts would differ in too many.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(WORDS, np.uint64)
    h = np.unique(_hashes(words, shingle, 1))[:, None]
    ones = np.zeros(BITS * WORDS, np.int64)
    for at in range(0, len(h), 255):  # bounds the unpacked bits, whose sums are bytes
        ones += np.unpackbits(_mixed(h[at : at + 255]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    more = 1 + len(h) % 2
    one = h[(h[:255] * _MASK).argmin(axis=0), 0]
    ones += more * np.unpackbits(_mixed(one).view(np.uint8), bitorder="little")
    return np.packbits(ones * 2 > len(h) + more, bitorder="little").view(np.uint64)


def boxes(rings: np.ndarray) -> np.ndarray:
    """Rings -> rows of BOXES keys: the chain's start and the box there, which must agree."""
    return rings.view(np.uint16).astype(np.int64) << 7 | np.arange(BOXES)


def ahead(rings: np.ndarray) -> np.ndarray:
    """Rings -> for each of their BOXES chains the AHEAD boxes after the first, as two longs."""
    x = rings.view(np.uint16)
    after = np.lib.stride_tricks.sliding_window_view(np.concatenate([x, x[:, :AHEAD]], axis=1)[:, 1:], AHEAD, axis=1)
    return np.ascontiguousarray(after).view(np.int64)


#: What tests/llm calls a ring and its keys.
minima, bands = ring, boxes


def budget(similarity: float) -> int:
    """Bits in which rings of sets of that Jaccard similarity differ on average, and twelve standard deviations more."""
    n, rate = BITS * WORDS, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(n * rate + 12 * np.sqrt(n * rate * (1 - rate)))


def chain_goes_on(diff: np.ndarray, most: int) -> np.ndarray:
    """For rows of ahead() xor ahead(), the first box being equal: at which every prefix of the chain, from 2 to AHEAD + 1
    boxes, stays within its share of ``most`` bits in BOXES."""
    at = np.flatnonzero(np.bitwise_count(diff).sum(axis=1, dtype=np.int64) * BOXES <= (AHEAD + 1) * most)
    sums = np.bitwise_count(diff[at].view(np.uint16)).cumsum(axis=1, dtype=np.int64)
    return at[(sums * BOXES <= np.arange(2, AHEAD + 2) * most).all(axis=1)]


def exactly(sets: list[np.ndarray], similarity: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For spanning(): at which places two of the sorted sets have that Jaccard similarity or more."""
    size = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(size) - size
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    n = len(distinct)

    def items(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets at these places in a row, and the place in ``at`` of each item."""
        of = np.repeat(np.arange(len(at)), size[at])
        first = np.cumsum(size[at]) - size[at]
        return flat[np.arange(len(of)) - first[of] + starts[at][of]], of

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        b, of = items(j)
        if (i == i[0]).all():
            marked = np.zeros(n, bool)
            marked[flat[starts[i[0]] : starts[i[0]] + size[i[0]]]] = True
            hit = marked[b]
        else:
            a, of_a = items(i)
            a, b = of_a * n + a, of * n + b
            hit = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b
        return np.bincount(of[hit], minlength=len(j))

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        maybe = np.flatnonzero(np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
        if len(maybe):
            part = np.cumsum(size[j[maybe]]) // 500_000  # bounds the items at hand
            for at in np.split(maybe, np.flatnonzero(np.diff(part)) + 1):
                both = common(i[at], j[at])
                out[at] = both >= similarity * (size[i[at]] + size[j[at]] - both) - 1e-9
        return np.flatnonzero(out)

    return linked


def _rings(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, WORDS)


def _hamming(rings: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which these rings differ; some pairs at a time bounds what is at hand."""
    parts = [np.bitwise_count(rings[i[at : at + 65_536]] ^ rings[j[at : at + 65_536]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), 65_536)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


#: A component of candidates with more than so many times GROUP nodes is compared in pairs of blocks of that size.
BLOCK = 16


def grouped(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, group: int = GROUP) -> DataFrame:
    """docs with row (unique), node and component (long): rows of one component are linked by near-copies.

    A link is a Jaccard similarity of ``similarity`` or more of the sets of hashes of ``shingle``-word shingles. Nodes
    are candidates if a box of their rings agrees and the chain that starts there goes on within its budget; candidates
    that reach one another are one component. In each component all pairs are compared, by the full Hamming distance of
    their rings and then exactly, but for those that links join already. Every node meets all that have one of its boxes,
    however many; a component of more than BLOCK * ``group`` nodes is dealt out in pairs of blocks. Texts equal but for
    A-Z case and white space are one node. Null and wordless texts are one node.
    """
    kept = [c for c in docs.columns if c not in ("row", "component", "node", "ring")]
    docs = docs.select(*kept)
    most = budget(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data = byte_texts(b.column("text"))
            node = np.array([xxhash.xxh3_64_intdigest(b" ".join(x.lower().split())) for x in data], np.uint64).view(np.int64)
            rings = pa.array([ring(x, shingle).tobytes() for x in data], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(node), rings], [*kept, "node", "ring"])

    def chains(lo: int, hi: int) -> Callable:
        """For mapInArrow: the rings' chains with starts from lo to hi."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rings = _rings(b.column("ring").to_pylist())
                after = ahead(rings)[:, lo:hi]
                cols = [boxes(rings)[:, lo:hi].ravel(), np.repeat(b.column("id").to_numpy(), hi - lo), after[:, :, 0].ravel(), after[:, :, 1].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "id", "next", "last"])

        return run

    def candidates(col: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        of, after = col["id"], np.stack([col["next"], col["last"]], axis=1).view(np.uint64)

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            hit = of[i] == of[j]
            at = np.flatnonzero(~hit)
            hit[at[chain_goes_on(after[i[at]] ^ after[j[at]], most)]] = True
            return np.flatnonzero(hit)

        return [(i, j) for i, j in stars(spanning(col["group"], linked)) if of[i] != of[j]]

    def met(rings: DataFrame, lo: int, hi: int) -> DataFrame:
        """(a, b) whose components are those of all candidates by these chains; rows of one id are one already."""
        keyed = rings.mapInArrow(chains(lo, hi), "key long, id long, next long, last long")
        return keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_by_key(candidates), "a long, b long")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(_hashes(w, shingle, 1).view(np.int64)) if (w := x.lower().split()) else np.zeros(0, np.int64) for x in byte_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ring"), pa.array(sets, pa.list_(pa.int64()))], ["id", "ring", "set"])

    def linked_in(rings: np.ndarray, sets: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        exact = exactly(sets, similarity)

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(_hamming(rings, i, j) <= most)
            return at[exact(i[at], j[at])]

        return linked

    def link(col: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        first = np.flatnonzero(np.diff(col["group"], prepend=-1))
        starts = first[np.flatnonzero(np.diff(first // 500, prepend=-1))]  # some groups at a time: bounds the sets at hand
        out: list[tuple[int, int]] = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(col["group"])], strict=True):
            found = spanning(col["group"][lo:hi] - col["group"][lo], linked_in(_rings(col["ring"][lo:hi].tolist()), list(col["set"][lo:hi])))
            out += [(lo + i, lo + j) for i, j in found]
        return out

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = docs.mapInArrow(run, f"{types}, node long, ring binary")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "near-copies")
    nodes = staged(rows.groupBy(F.col("node").alias("id")).agg(F.first("ring").alias("ring")), "near-copy-nodes")
    early = staged(components(met(nodes, 0, EARLY)), "near-copy-early")
    e = early.select(F.col("node").alias("n_"), "root")
    merged = nodes.join(e, F.col("id") == F.col("n_"), "left").select(F.coalesce("root", "id").alias("id"), "ring")
    near_ones = components(met(merged, EARLY, BOXES).unionByName(early.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    near_ones = staged(near_ones.withColumnsRenamed({"node": "n_", "root": "root_"}), "near-copy-candidates")
    blocks = near_ones.groupBy("root_").agg(F.ceil(F.count("*") / (BLOCK * group)).cast("int").alias("blocks"))
    other = F.explode(F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))).otherwise(F.array(F.lit(0))))
    place = near_ones.join(blocks, "root_").withColumn("block", F.pmod(F.xxhash64("n_"), "blocks").cast("int")).withColumn("other", other)
    place = place.select("n_", F.xxhash64("root_", F.least("block", "other"), F.greatest("block", "other")).alias("key"))
    texts = rows.join(near_ones, rows["node"] == near_ones["n_"], "left_semi").groupBy(F.col("node").alias("id")).agg(F.first("text").alias("text"), F.first("ring").alias("ring"))
    sets = texts.mapInArrow(sets_of, "id long, ring binary, set array<long>")
    sets = place.join(sets, place["n_"] == sets["id"]).select("key", "id", "ring", "set")
    found = components(sets.repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(link), "a long, b long"))
    f = found.select(F.col("node").alias("n_"), "root")
    of = nodes.select("id").join(f, F.col("id") == F.col("n_"), "left").select("id", F.coalesce("root", "id").alias("component"))
    return rows.drop("ring").join(of, rows["node"] == of["id"]).drop("id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """The rows of docs with the smallest doc_id of each component of grouped(), one row each; null ids come last."""
    own = {c: f"{c} of docs" if c.lower() in ("row", "node", "ring", "component") else c for c in docs.columns}
    rows = grouped(docs.withColumnsRenamed(own), **how)
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best"))
    rows = rows.join(best.select(F.col("best.row").alias("row")), "row", "left_semi")
    return rows.select(*own.values()).withColumnsRenamed({v: c for c, v in own.items()})


def hex16(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
