"""Near-duplicate documents by b-bit MinHash: bands for candidates, packed low bits for an estimate, full sets for the decision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import bytes_of, components, give_back, lean, mix, pieces, prefix, stretch, word_hashes

HASHES = 128
BITS = 4  # kept of each minimum; 16 minima share a 64-bit word
ROWS, BANDS = 3, 42  # a pair at the threshold 0.75 meets in no band with chance (1 - 0.75 ** 3) ** 42, about 1e-10
MARGIN = 0.25  # six standard deviations of the estimate below the threshold
BLOCK = 2048  # classes of a bucket on either side of the comparisons of one task
TILE = 256  # classes on either side of one comparison of packed bits
CHUNK = 2_000_000  # shingles on either side of the comparisons of one task
WIDE = 512  # minima of classes whose buckets stay open
WIDE_MARGIN = 0.125  # six standard deviations of their estimate
FACTORS = mix(np.arange(1, WIDE + 1, dtype=np.uint64)) | np.uint64(1)
LOW = np.uint64((1 << BITS) - 1)
ONES = 0x1111111111111111


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as 64-bit hashes in order, and where each text's begin (n + 1 places).

    A text of fewer words than ``k`` has its whole sequence as the only shingle, one without words has none.
    """
    words, at = word_hashes([t.lower() for t in texts])
    sums = prefix(words)
    count = np.diff(at)
    grams = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), grams)
    first = np.cumsum(grams) - grams
    start = at[owner] + np.arange(len(owner)) - first[owner]
    values = stretch(sums, start, start + np.minimum(count, k)[owner])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_keys(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set, as two columns."""
    keys = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(salt)), out=sums[1:])
        keys.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return keys[0], keys[1]


def minima_of(values: np.ndarray, at: np.ndarray, hashes: int) -> np.ndarray:
    """The minima of sets that are not empty, a row a hash."""
    minima = np.empty((hashes, len(at)), np.uint64)
    for j in range(hashes if len(at) else 0):
        minima[j] = np.minimum.reduceat(values * FACTORS[j], at)
    return minima


def pack_low(minima: np.ndarray) -> np.ndarray:
    """The low bits of each set's minima, 16 minima a word."""
    packed = np.zeros((minima.shape[1], len(minima) * BITS // 64), np.uint64)
    for j, low in enumerate(mix(minima) & LOW):
        packed[:, j // 16] |= low << np.uint64(BITS * (j % 16))
    return packed


def sketch(docs: DataFrame, k: int = 5) -> DataFrame:
    """``doc_id, n, k1, k2, packed, bands`` of every row: set size, set name, packed low bits of the minima, band hashes.

    Words are split at ASCII white space and A-Z is lowered. Rows without words have no bands.
    """
    def rows(ids, texts):
        values, at = shingle_sets([bytes_of(t) for t in texts], k)
        k1, k2 = set_keys(values, at)
        filled = np.flatnonzero(np.diff(at))
        minima = minima_of(values, at[filled], HASHES)
        packed = pack_low(minima)
        bands = np.empty((len(filled), BANDS), np.uint64)
        for b in range(BANDS):
            value = np.full(len(filled), b + 1, np.uint64)
            for j in range(b * ROWS, (b + 1) * ROWS):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + minima[j])
            bands[:, b] = value
        lists = []
        for table in (packed, bands):
            sizes = np.zeros(len(texts) + 1, np.int32)
            sizes[1:][filled] = table.shape[1]
            lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(table.view(np.int64).ravel())))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(at)), pa.array(k1), pa.array(k2), *lists], names=["doc_id", "n", "k1", "k2", "packed", "bands"])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in pieces(texts):
                yield rows(ids[a:b], texts[a:b])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, "powers"), "doc_id long, n long, k1 long, k2 long, packed array<long>, bands array<long>")


def estimate(one: str, other: str) -> Column:
    """Jaccard similarity from equal low bits: chance agreement of ``1 / 2 ** BITS`` is taken off."""
    unlike = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.col(one)[i].bitwiseXOR(F.col(other)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(ONES)))
    chance = 1 / (1 << BITS)
    return ((1 - unlike / F.lit(float(HASHES))) - chance) / (1 - chance)


def likely(threshold: float) -> Column:
    """Pairs ``na, nb, e`` (sizes and estimate) that can reach the threshold."""
    fits = (F.col("na") >= F.lit(threshold - 1e-9) * F.col("nb")) & (F.col("nb") >= F.lit(threshold - 1e-9) * F.col("na"))
    return fits & (F.col("e") >= threshold - MARGIN)


def full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, k: int, wide: bool = False) -> DataFrame:
    """``node, members``: the full shingle sets of classes, in order; only their texts are read into sets. ``wide`` adds the low bits of ``WIDE`` minima."""
    named = classes.join(nodes, "node").select("node", F.col("rep").alias("doc_id"), "k1", "k2")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(named.select("doc_id").distinct(), "doc_id", "left_semi")

    def sets(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in pieces(texts):
                values, at = shingle_sets([bytes_of(t) for t in texts[a:b]], k)
                k1, k2 = set_keys(values, at)
                raw = [values[x:y].tobytes() for x, y in zip(at.tolist(), at[1:].tolist())]
                columns = {"doc_id": pa.array(ids[a:b], pa.int64()), "k1": pa.array(k1), "k2": pa.array(k2), "members": pa.array(raw, pa.binary())}
                if wide:
                    filled = np.flatnonzero(np.diff(at))
                    bits: list = [None] * (b - a)
                    for i, row in zip(filled.tolist(), pack_low(minima_of(values, at[filled], WIDE))):
                        bits[i] = row.tobytes()
                    columns["wide"] = pa.array(bits, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    made = texts.mapInArrow(lean(sets, "powers"), "doc_id long, k1 long, k2 long, members binary" + (", wide binary" if wide else ""))
    return settle(made.join(named, ["doc_id", "k1", "k2"]).dropDuplicates(["node"]).drop("doc_id", "k1", "k2"), "sets")


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes whose full sets overlap by ``percent`` of their union; each set is made once and written."""
    made = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), docs, classes, k)

    def compare(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[place] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(made.select(F.col("node").alias("a"), F.col("members").alias("left")), "a").join(
        made.select(F.col("node").alias("b"), F.col("members").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(lean(compare, "powers"), "a long, b long")


def agree(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimates of all rows of packed bits against all others, as ``estimate`` gives them."""
    unlike = np.zeros((len(one), len(other)), np.uint16)
    for i in range(one.shape[1]):
        x = one[:, i][:, None] ^ other[:, i][None]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        unlike += np.bitwise_count(x & np.uint64(ONES))
    chance = 1 / (1 << BITS)
    return ((1 - unlike / np.float32(one.shape[1] * 64 // BITS)) - chance) / (1 - chance)


def alike(asking: tuple, held: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of two lists ``n, component, packed`` in order of n that lie in different components and can reach the threshold."""
    (n, c, p), (m, d, q) = asking, held
    one, other = [], []
    for i in range(0, len(n), TILE):
        rows = slice(i, i + TILE)
        low, high = np.searchsorted(m, [(threshold - 1e-9) * n[rows][0], n[rows][-1] / (threshold - 1e-9) + 1])
        for j in range(low, high, TILE):
            to = slice(j, min(j + TILE, high))
            small, large = np.minimum.outer(n[rows], m[to]), np.maximum.outer(n[rows], m[to])
            hit = (small >= (threshold - 1e-9) * large) & (c[rows][:, None] != d[to][None])
            if hit.any():
                x, y = np.nonzero(hit & (agree(p[rows], q[to]) >= threshold - WIDE_MARGIN))
                one.append(x + i)
                other.append(y + j)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *one]), np.concatenate([empty, *other])


def open_tasks(placed: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets ``band, node, component`` that hold several components, dealt into tasks: rows ``part, big, i, j, asks, held, band, node, n, component``, and their nodes.

    In a bucket the classes outside its largest component ask all its classes. Both sides are cut into blocks of about ``BLOCK``
    classes and ``CHUNK`` shingles; a task has one block of askers and one of the others, small buckets share a task. No
    pair is left out.
    """
    sized = placed.join(marks.select("node", "n"), "node")
    kinds = sized.groupBy("band", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("band").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"), F.max_by("s", F.struct("c", "component")).alias("main_s"), F.sum("c").alias("size"),
        F.max("c").alias("most"), F.sum("s").alias("whole"), F.count("*").alias("kinds"))

    def needed(classes: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(classes / BLOCK), F.ceil(shingles / CHUNK)).cast("int")

    kinds = kinds.filter("kinds > 1 AND size > 2").select(
        "band", "main", needed(F.col("size") - F.col("most"), F.col("whole") - F.col("main_s")).alias("ask_blocks"), needed(F.col("size"), F.col("whole")).alias("blocks"))
    rows = settle(sized.join(kinds, "band"), "open")
    count, shingles = rows.agg(F.count("*"), F.sum("n")).first()
    parts = max(1, count // (4 * BLOCK), (shingles or 0) // (2 * CHUNK))
    part = F.when(F.col("blocks") > 1, F.col("band")).otherwise(F.pmod(F.xxhash64("band"), F.lit(parts)))
    columns = ["band", "node", "n", "component", (F.col("component") == F.col("main")).alias("held")]

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(of)).cast("int")

    def to_all(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    big = F.col("blocks") > 1
    asks = rows.filter("component <> main").select(part.alias("part"), big.alias("big"), block("ask_blocks").alias("i"), to_all("blocks").alias("j"), F.lit(True).alias("asks"), *columns)
    asked = rows.select(part.alias("part"), big.alias("big"), to_all("ask_blocks").alias("i"), block("blocks").alias("j"), F.lit(False).alias("asks"), *columns)
    return asks.union(asked), rows.select("node").distinct()


def candidates(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a task's table of all pairs of its buckets in different components that can reach the threshold, each pair of classes once."""
    band, node, n, component = (table.column(c).to_numpy() for c in ("band", "node", "n", "component"))
    wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(len(node), -1)
    asking, held = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "held"))
    order = np.lexsort((node, n, held, ~asking, band))
    starts = np.flatnonzero(np.diff(band[order], prepend=band[order[0]] - 1))
    one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, to in zip(starts, [*starts[1:], len(order)]):
        here = order[at:to]
        mine, others, main = here[asking[here]], here[~asking[here] & ~held[here]], here[held[here]]
        for theirs in (others, main):
            x, y = alike((n[mine], component[mine], wide[mine]), (n[theirs], component[theirs], wide[theirs]), threshold)
            one.append(mine[x])
            other.append(theirs[y])
    x, y = np.concatenate(one), np.concatenate(other)
    least, most = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
    _, first = np.unique(np.stack([least, most]), axis=1, return_index=True)
    return x[first], y[first]


def join_open(placed: DataFrame, marks: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``a, b`` that join components of the classes that share a bucket, found by judging every pair of an open bucket.

    Pairs stay inside their task. A first pass over the tasks names the classes that have a candidate there; a second one gets their full
    sets, confirms the candidates and sends a link only if it joins two components that no link of the task has joined: fewer links
    than classes.
    """
    threshold = percent / 100
    tasks, nodes = open_tasks(placed, marks)
    made = full_sets(nodes, docs, classes, k, wide=True)
    marked, place = tasks.join(made.select("node", "wide"), "node"), ["part", "big", "i", "j"]

    def near(table: pa.Table) -> pa.Table:
        give_back("powers")
        table = table.combine_chunks()
        x, y = candidates(table, threshold)
        found = np.unique(table.column("node").to_numpy()[np.concatenate([x, y])])
        return pa.table({**{c: pa.array([table.column(c)[0].as_py()] * len(found), table.schema.field(c).type) for c in place}, "node": pa.array(found, pa.int64())})

    wanted = settle(marked.groupBy(*place).applyInArrow(near, "part long, big boolean, i int, j int, node long"), "near")

    def linked(table: pa.Table) -> pa.Table:
        give_back("powers")
        table = table.combine_chunks()
        x, y = candidates(table, threshold)
        node, component, members = table.column("node").to_numpy(), table.column("component").to_numpy(), table.column("members")
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        def members_of(i: int) -> np.ndarray:
            return np.frombuffer(members[i].as_buffer(), np.uint64)

        links = []
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        for i, at, to in zip(*np.unique(x, return_index=True), [*np.unique(x, return_index=True)[1][1:], len(x)]):
            mine = members_of(int(i))
            for start in range(int(at), int(to), 64):
                some = [j for j in y[start : min(start + 64, int(to))].tolist() if find(int(component[i])) != find(int(component[j]))]
                if not some:
                    continue
                theirs = [members_of(j) for j in some]
                sizes = np.array([len(t) for t in theirs])
                values = np.concatenate(theirs)
                equal = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
                common = np.add.reduceat(equal.astype(np.int64), np.cumsum(sizes) - sizes)
                for j, hit in zip(some, 100 * common >= percent * (len(mine) + sizes - common)):
                    u, v = find(int(component[i])), find(int(component[j]))
                    if hit and u != v:
                        root[u] = v
                        links.append((min(node[i], node[j]), max(node[i], node[j])))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    chosen = marked.join(wanted, [*place, "node"], "left_semi").join(made.select("node", "members"), "node")
    return chosen.groupBy(*place).applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs (doc_id, text)``.

    Documents with 100 * intersection >= ``percent`` * union of their shingle sets are linked; a component is named by its
    smallest doc_id and that document is kept. Equal sets form one class at once, and only classes are compared. In every band
    bucket all classes are compared with the smallest one and with one more, so a group of n alike costs about n comparisons a
    bucket instead of n * n / 2. Where a bucket still spans several components, all its pairs in different components are
    compared on ``WIDE`` minima, in blocks, inside tasks that send links only (``join_open``). Every link is confirmed on the full sets. A link is missed only if its classes meet in no band or the
    estimate of 128 minima is six standard deviations too low. A bucket of n classes that are not linked costs n * n / 2
    comparisons of packed bits, spread over tasks of two blocks.

    Rows without words are linked with nothing. Rows of one doc_id are one document. A null doc_id is linked with nothing, has a
    null component and is kept. No input gives no row.
    """
    threshold = percent / 100
    sketches = settle(sketch(docs, k), "sketches")
    classes = sketches.filter("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "packed", "bands")).alias("_least"))
    classes = settle(classes.select(
        F.monotonically_increasing_id().alias("node"), "k1", "k2", "n", F.col("_least.doc_id").alias("rep"), "_least.packed", "_least.bands"), "classes")
    marks = classes.select("node", "n", "packed")

    def side(x: str) -> DataFrame:
        return marks.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("packed").alias(f"p{x}"))

    bands = classes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("_most")).filter("least <> _most")
    shared = settle(bands.join(shared.drop("_most"), "band"), "buckets")
    def rated(pairs: DataFrame) -> DataFrame:
        whole = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("e", estimate("pa", "pb"))
        return settle(whole.filter(likely(threshold)).select("a", "b"), "pairs")

    star = rated(shared.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    links = settle(confirm(star, docs, classes, k, percent), "links")
    # rows of one doc_id with different texts belong together
    members = sketches.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "k1", "k2", "n").join(classes.select("k1", "k2", "n", "node", "rep"), ["k1", "k2", "n"])
    twice = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_most")).filter("a <> _most")
    twice = members.join(twice, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")
    links = settle(links.union(twice), "links")
    found = components(links, "stars")

    # in buckets that span several components another class is compared with the others
    placed = shared.select("band", "node").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    other = placed.groupBy("band").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", "band")).alias("_z"), F.min("component").alias("_least"), F.max("component").alias("_most"))
    other = other.filter("_least <> _most").select("band", "_z")
    turn = placed.join(other, "band").filter("component <> _z.component").select(F.least("_z.node", "node").alias("a"), F.greatest("_z.node", "node").alias("b")).distinct()
    turn = rated(turn.join(star, ["a", "b"], "left_anti"))
    links = settle(links.union(confirm(turn, docs, classes, k, percent)), "links")
    found = components(links, "stars")

    # what is left: the other pairs of buckets that still span several components
    placed = shared.select("band", "node").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = settle(join_open(placed, marks, docs, classes, k, percent), "links")
    if not more.isEmpty():
        found = components(links.union(more), "stars")

    rooted = classes.select("node", "rep").join(found.withColumnRenamed("id", "node"), "node")
    named = rooted.groupBy("component").agg(F.min("rep").alias("component_id")).join(found, "component").select(F.col("id").alias("node"), "component_id")
    of_class = classes.select("k1", "k2", "n", "node", "rep").join(named, "node", "left").select("k1", "k2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    out = sketches.select("doc_id", "n", "k1", "k2").join(of_class, ["k1", "k2", "n"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
