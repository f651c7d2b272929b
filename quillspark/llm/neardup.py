"""Groups of near-duplicate texts by BK-trees over Hamming distance (problem 3).

1. ``sketch``: each text is read once. Its distinct runs of consecutive words are hashed; the least values under different
   hash functions give shard keys (a few values each) and a fingerprint: two bits of each value, which for texts of similarity
   s differ in (1 - s) / 2 of the bits on average and for unlike ones in half, behind a thermometer code of the logarithm of
   the set's size, ``WEIGHT`` bits for each ``STEP``.
2. Equal shingle sets are one class with one representative; only representatives are compared.
3. ``shard_pairs``: a shard holds the representatives that agree in one shard key; shards of one go at once. Each shard is a
   BK-tree whose children are keyed by their integer Hamming distance to the parent; a probe follows only edges within the
   radius. The bits of least values alone lie too close together for the triangle inequality to exclude anything; the sizes
   do not: on pages, a probe meets about a fifth of a tree at similarity 0.8 and two fifths at 0.6, little more than the
   texts whose size allows the similarity at all. The trees grow with the data, so they are
   sent to the tasks that hold a shard's probes, not to every worker; a shard beyond ``TREE`` rows is cut by size of the
   shingle set and salt into sub-trees, each built once and probed by the blocks whose sizes allow the similarity.
4. ``verified``: candidates are checked on the shingles that the sketch has stored.

Chance of missing a pair at the threshold: ``LOSS`` by shards and 0.01 % by the radius, and less above it. With ``exact``
the shards are the first shingles of each set instead, of which two sets of the similarity always share one, and the radius
is the whole fingerprint: no pair is lost, for more rows (a share of 1 - similarity of all shingles in place of some 36 keys).
Shingles are compared by 32 bits of their hashes: a pair of 300 shingles has one false agreement with a chance of 1 in 50,000.

Defined results: null and empty texts, those without words and those under the least number of words have no links; a
text of fewer words than a shingle is one shingle; rows of equal id are one row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.boilerplate import host_winners, main_form, over_pages
from quillspark.runtime import broadcast_if_small, materialize, small

LOSS = 2e-4
"""At the threshold, a pair may share no shard with this chance."""
HASHES = 110
"""At most so many least values are taken."""
BITS_EACH = 2
TREE = 2_000
"""A BK-tree holds at most so many fingerprints."""
STEP, WEIGHT = 0.01, 100
"""The size of a shingle set counts ``WEIGHT`` bits for each ``STEP`` of its logarithm."""
PRINT_BITS = 224
CHUNK = 200_000
"""Texts are split into words together, up to so many characters."""
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(1, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 63)) * 2 + 1
_TABLED = 0x30000
_WORD = np.fromiter(map(str.isalnum, map(chr, range(_TABLED))), bool, _TABLED)
"""Which characters are letters or digits."""


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing generator: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shape(similarity: float) -> tuple[int, int]:
    """``(keys, values of each)``: as many values as fit ``HASHES`` with enough keys that a pair of ``similarity`` shares
    none with a chance of at most ``LOSS``."""
    for rows in range(8, 1, -1):
        agree = similarity**rows
        keys = 1 if agree >= 1 else math.ceil(math.log(LOSS) / math.log1p(-agree))
        if keys * rows <= HASHES:
            return keys, rows
    return HASHES, 1


class _Powers:
    """Powers of the base of word hashes and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), CHUNK)
            self.up, self.down = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers()


def _words(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text, maximal runs of letters and digits in lower case, in order."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(code) + 2, bool)
    if len(code) and code.max() >= _TABLED:
        inside[1:-1] = [chr(c).isalnum() for c in code.tolist()]
    else:
        inside[1:-1] = _WORD[code]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    up, down = _powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    h = _mix((sums[ends] - sums[starts]) * down[starts])
    cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in low]))
    return np.split(h, cuts[:-1])


def _distinct(h: np.ndarray) -> np.ndarray:
    h = (h >> np.uint64(32)).astype(np.uint32)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingles(texts: list[str], width: int, least_words: int) -> list[np.ndarray | None]:
    """For each text in its form: the sorted distinct 32-bit hashes of ``width`` consecutive words, or of all its words if
    they are fewer; None for a text of fewer than ``least_words`` or none."""
    out: list[np.ndarray | None] = []
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= CHUNK:
            size += len(texts[end])
            end += 1
        for h in _words(texts[at:end]):
            if len(h) < max(least_words, 1):
                out.append(None)
                continue
            w = min(width, len(h))
            n = len(h) - w + 1
            mixed = h[:n] * _STEP[0]
            for k in range(1, w):
                mixed += h[k : k + n] * _STEP[k]
            out.append(_distinct(_mix(mixed)))
        at = end
    return out


def signature(sh: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of the shingles under each hash function."""
    least = None
    for k in range(0, len(sh), 8192):
        m = (sh[k : k + 8192] * _MUL[:hashes] + _ADD[:hashes]).min(axis=1)
        least = m if least is None else np.minimum(least, m)
    return least.astype(np.uint64)


def _keys(least: np.ndarray, sizes: list[int], keys: int, rows: int) -> tuple[list[bytes], np.ndarray]:
    """Fingerprints, the steps of the size before the bits, and shard keys of a batch of signatures, one row each."""
    mixed = _mix(least + np.uint64(1))
    bits = np.stack([(mixed >> np.uint64(17 + k)) & np.uint64(1) for k in range(BITS_EACH)], axis=2).astype(bool)
    packed = np.packbits(bits.reshape(len(mixed), bits.shape[1] * BITS_EACH), axis=1)
    prints = [int(math.log(n) / STEP).to_bytes(4, "big") + x.tobytes().rjust(PRINT_BITS // 8, b"\0") for n, x in zip(sizes, packed)]
    t = mixed[:, : keys * rows].reshape(len(mixed), keys, rows)
    out = np.broadcast_to(_STEP[:1], t.shape[:2]) + np.arange(keys, dtype=np.uint64)
    for k in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + t[:, :, k])
    return prints, out.view(np.int64)


def radius(similarity: float, hashes: int, exact: bool = False) -> int:
    """Hamming radius that a pair of ``similarity`` exceeds with a chance of about 1 in 10,000, with ``exact`` never."""
    unlike = 1 - similarity
    variance = hashes * unlike * (BITS_EACH / 4 + BITS_EACH**2 / 4 * similarity)
    bits = min(BITS_EACH * hashes, round(BITS_EACH * hashes * unlike / 2 + 3.75 * variance**0.5))
    return (BITS_EACH * hashes if exact else bits) + WEIGHT * (math.ceil(-math.log(similarity) / STEP) + 1)


def first_shingles(sh: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the first shingles that a set of the similarity has one of them among its own first ones."""
    return sh[: len(sh) - math.ceil(similarity * len(sh) - 1e-9) + 1].astype(np.int64)


def sketch(pages: DataFrame, winners: DataFrame, width: int, least_words: int, similarity: float, exact: bool = False, **columns) -> DataFrame:
    """``(doc_id, set_key, size, print, shards, sh)`` of every page whose main text has enough words."""
    keys, rows = shape(similarity)
    hashes = keys * rows

    def run(ids, texts, wons):
        kept = [(i, main_form(t, w)) for i, t, w in zip(ids, texts, wons) if t and i is not None]
        sets = shingles([t for _, t in kept], width, least_words)
        out = [i for (i, _), sh in zip(kept, sets) if sh is not None]
        sets = [sh for sh in sets if sh is not None]
        least = np.stack([signature(sh, hashes) for sh in sets]) if sets else np.zeros((0, hashes), np.uint64)
        prints, shards = _keys(least, [len(sh) for sh in sets], keys, rows)
        if exact:
            lists = pa.array([first_shingles(sh, similarity) for sh in sets], pa.list_(pa.int64()))
        else:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * keys, pa.int32()), pa.array(shards.ravel(), pa.int64()))
        raw = [sh.tobytes() for sh in sets]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(out, pa.int64()), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array([len(x) // 4 for x in raw], pa.int32()),
                pa.array(prints, pa.binary()), lists, pa.array(raw, pa.binary()),
            ],
            names=["doc_id", "set_key", "size", "print", "shards", "sh"],
        )

    return over_pages(pages, winners, run, "doc_id long, set_key binary, size int, print binary, shards array<long>, sh binary", **columns)


_BITS = (1 << PRINT_BITS) - 1


def distance(a: int, b: int) -> int:
    """The Hamming distance of two fingerprints, their thermometers not spelled out."""
    return ((a ^ b) & _BITS).bit_count() + WEIGHT * abs((a >> PRINT_BITS) - (b >> PRINT_BITS))


class BKTree:
    """A metric tree over fingerprints under Hamming distance; equal values share a node."""

    def __init__(self):
        self.value: list[int] = []
        self.rows: list[list[int]] = []
        self.edges: list[dict[int, int]] = []
        self.met = 0  # nodes that probes have met

    def add(self, value: int, row: int) -> None:
        if not self.value:
            self._new(value, row)
            return
        at = 0
        while True:
            d = distance(self.value[at], value)
            if d == 0:
                self.rows[at].append(row)
                return
            below = self.edges[at].get(d)
            if below is None:
                self.edges[at][d] = len(self.value)
                self._new(value, row)
                return
            at = below

    def _new(self, value: int, row: int) -> None:
        self.value.append(value)
        self.rows.append([row])
        self.edges.append({})

    def within(self, value: int, r: int) -> list[int]:
        """Rows whose value is within ``r``: an edge of length e can lead there only if |e - d| <= r."""
        found: list[int] = []
        todo = [0] if self.value else []
        while todo:
            at = todo.pop()
            self.met += 1
            d = distance(self.value[at], value)
            if d <= r:
                found += self.rows[at]
            if e := self.edges[at]:
                todo += [n for x, n in e.items() if d - r <= x <= d + r]
        return found


def _number(print_: bytes) -> int:
    return int.from_bytes(print_, "big")


def _tree_pairs(ids: list[int], prints: list[int], r: int) -> list[tuple[int, int]]:
    tree, out = BKTree(), []
    for k, (i, f) in enumerate(zip(ids, prints)):
        out += [(min(i, ids[j]), max(i, ids[j])) for j in tree.within(f, r) if ids[j] != i]
        tree.add(f, k)
    return out


def _shards(r: int):
    """Rows sorted by shard -> candidate pairs; a shard may span batches, and holds at most ``TREE`` rows."""

    def run(batches):
        shard, ids, prints = None, [], []
        for b in batches:
            found: set[tuple[int, int]] = set()
            for s, i, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if s != shard:
                    found.update(_tree_pairs(ids, prints, r))
                    shard, ids, prints = s, [], []
                ids.append(i)
                prints.append(_number(f))
            yield _batch(found)
        yield _batch(set(_tree_pairs(ids, prints, r)))

    return run


def _batch(found) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])


_TREE = "shard long, size_class int, salt long, ids array<long>, prints array<binary>, parents array<int>"


def _planted(t: pa.Table) -> pa.Table:
    """One block of an oversize shard as a tree: its rows in the order of their nodes, and each node's parent."""
    ids, prints = t.column("id").to_pylist(), t.column("print").to_pylist()
    tree = BKTree()
    for k, f in enumerate(prints):
        tree.add(_number(f), k)
    parent = [-1] * len(tree.value)
    for k, e in enumerate(tree.edges):
        for n in e.values():
            parent[n] = k
    order = [(n, k) for n, rows in enumerate(tree.rows) for k in rows]
    one = {c: [t.column(c)[0].as_py()] for c in ("shard", "size_class", "salt")}
    return pa.table(one | {"ids": [[ids[k] for _, k in order]], "prints": [[prints[k] for _, k in order]], "parents": [[-2 if j and order[j - 1][0] == n else parent[n] for j, (n, _) in enumerate(order)]]}, schema=_TREE_ARROW)


_TREE_ARROW = pa.schema([("shard", pa.int64()), ("size_class", pa.int32()), ("salt", pa.int64()), ("ids", pa.list_(pa.int64())), ("prints", pa.list_(pa.binary())), ("parents", pa.list_(pa.int32()))])


def _grown(ids: list[int], prints: list[int], parents: list[int]) -> BKTree:
    """The tree behind ``parents``; a row with parent -2 stands in the node of the row before."""
    tree = BKTree()
    for k, (f, p) in enumerate(zip(prints, parents)):
        if p == -2:
            tree.rows[-1].append(k)
            continue
        if p >= 0:
            tree.edges[p][distance(tree.value[p], f)] = len(tree.value)
        tree._new(f, k)
    return tree


def _block_pairs(r: int):
    """One row for each pair of blocks of an oversize shard: the tree of the one, probed by the other."""

    def run(batches):
        for b in batches:
            out = set()
            for x in b.to_pylist():
                ids = x["ids"]
                tree = _grown(ids, [_number(f) for f in x["prints"]], x["parents"])
                for i, f in zip(ids if x["same"] else x["other_ids"], x["prints"] if x["same"] else x["other_prints"]):
                    out.update((min(i, ids[j]), max(i, ids[j])) for j in tree.within(_number(f), r) if ids[j] != i)
            yield _batch(out)

    return run


def shard_pairs(reps: DataFrame, r: int, similarity: float, tree_rows: int = TREE) -> DataFrame:
    """Candidate pairs ``(a, b)``, a < b, of ``reps(id, size, print, shards)`` that share a shard and lie within ``r``."""
    rows = reps.select(F.explode("shards").alias("shard"), "id")
    shared = materialize(rows.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"))
    met = materialize(rows.join(broadcast_if_small(shared, 200_000), "shard"))
    full = met.join(reps.select("id", "size", "print"), "id")
    usual = full.filter(F.col("n") <= tree_rows).select("shard", "id", "print")
    found = usual.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards(r), "a long, b long")
    hot = shared.filter(F.col("n") > tree_rows)
    if not small(hot, 0):
        # Sets of the similarity have sizes of the same class or of neighbours.
        size_class = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(similarity) if similarity < 1 else 1.0) + 1e-9).cast("int")
        blocks = full.filter(F.col("n") > tree_rows).withColumn("size_class", size_class).withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (tree_rows / 2))))
        trees = materialize(blocks.select("shard", "size_class", "salt", "id", "print").groupBy("shard", "size_class", "salt").applyInArrow(_planted, _TREE))
        near = trees.withColumn("near", F.explode(F.array(F.col("size_class"), F.col("size_class") + 1)))
        left, right = near.alias("l"), trees.alias("r")
        same = F.col("l.size_class") == F.col("r.size_class")
        on = (F.col("l.shard") == F.col("r.shard")) & (F.col("l.near") == F.col("r.size_class")) & (~same | (F.col("l.salt") <= F.col("r.salt")))
        one = same & (F.col("l.salt") == F.col("r.salt"))
        both = left.join(right, on).select("l.ids", "l.prints", "l.parents", one.alias("same"), F.when(~one, F.col("r.ids")).alias("other_ids"), F.when(~one, F.col("r.prints")).alias("other_prints"))
        found = found.unionByName(both.repartition(F.rand(7)).mapInArrow(_block_pairs(r), "a long, b long"))
    return found.distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The candidates whose similarity reaches the threshold: ``(a, b, similarity)``; ``sets(id, sh)`` has the shingles."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sh = sets.join(broadcast_if_small(ends, 200_000), "id", "left_semi")
    a, b = sh.select(F.col("id").alias("a"), F.col("sh").alias("sh_a")), sh.select(F.col("id").alias("b"), F.col("sh").alias("sh_b"))

    def check(batches):
        for x in batches:
            keep, kept = [], []
            for k, (p, q) in enumerate(zip(x.column("sh_a"), x.column("sh_b"))):
                p, q = np.frombuffer(p.as_buffer(), np.uint32), np.frombuffer(q.as_buffer(), np.uint32)
                common = len(np.intersect1d(p, q, assume_unique=True))
                s = common / (len(p) + len(q) - common)
                if s >= similarity:
                    keep.append(k)
                    kept.append(s)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("a").take(at), x.column("b").take(at), pa.array(kept, pa.float64())], names=["a", "b", "similarity"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sh_a", "sh_b").mapInArrow(check, "a long, b long, similarity double")


def near_duplicates(
    pages: DataFrame, width: int = 5, similarity: float = 0.8, least_words: int = 1, tree_rows: int = TREE, exact: bool = False, **columns
) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives, and membership.

    Returns ``links(a, b, similarity)``, a < b, and ``members(doc_id, rep)``: every page with enough words and
    the representative (least id) of its class of equal shingle sets. Links cost no more for a class of a
    million copies than for one of one.
    """
    id_column, text, host = columns.get("id_column", "doc_id"), columns.get("text", "text"), columns.get("host", "source")
    pages = pages.select(id_column, text, host)
    sketched = materialize(sketch(pages, host_winners(pages, text, host), width, least_words, similarity, exact, **columns))
    classes = sketched.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("set_key", "rep")
    classes = materialize(classes)
    members = sketched.select("doc_id", "set_key").join(broadcast_if_small(classes, 200_000), "set_key", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).distinct()
    copies = materialize(members.filter("doc_id <> rep").select("doc_id"))
    reps = sketched.join(broadcast_if_small(copies, 200_000), "doc_id", "left_anti").withColumnRenamed("doc_id", "id")
    keys, rows = shape(similarity)
    r = radius(similarity, keys * rows, exact)
    pairs = materialize(shard_pairs(reps.select("id", "size", "print", "shards"), r, similarity, tree_rows))
    return materialize(verified(pairs, reps.select("id", "sh"), similarity)), members


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of documents: linked classes' members with each other, and members of one class."""
    members = materialize(members)
    several = members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    classes = links.select("a", "b").unionByName(several)
    left, right = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    both = classes.join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def grouped(links: DataFrame, members: DataFrame) -> DataFrame:
    """``(doc_id, group_id, n_links)``: the connected group of every member by its least id, and its class's links.

    Labels travel by hash-to-min with pointer jumping over the links between representatives, so rounds grow
    with the logarithm of a group's diameter; each round's table is written to the shared folder.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("g")))
    while True:
        around = edges.join(label.select(F.col("a").alias("b"), F.col("g")), "b").groupBy("a").agg(F.min("g").alias("near"))
        nearer = label.join(around, "a").select("a", F.least("g", "near").alias("g"), F.col("g").alias("old"))
        jumped = nearer.alias("n").join(label.select(F.col("a").alias("g"), F.col("g").alias("far")), "g", "left")
        step = materialize(jumped.select("a", F.least(F.col("g"), F.coalesce("far", "g")).alias("g"), "old"))
        if step.filter("g <> old").isEmpty():
            break
        label = step.select("a", "g")
    degree = edges.groupBy("a").agg(F.count("*").alias("n"))
    of = members.join(label.select(F.col("a").alias("rep"), "g"), "rep", "left").join(degree.select(F.col("a").alias("rep"), "n"), "rep", "left")
    return of.select("doc_id", F.coalesce("g", "rep").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"))


def every_group(pages: DataFrame, links: DataFrame, members: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``grouped`` for every page: one without shingles is a group of its own without links."""
    ids = pages.select(F.col(id_column).alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    of = ids.join(grouped(links, members), "doc_id", "left")
    return of.select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
