"""Near duplicates by min-max hashing, confirmed on full sets.

A text's set holds its distinct shingles of ``SHINGLE`` words (A-Z lower-cased; words are runs outside space and \\t-\\r),
as 64-bit hashes; a shorter text is one shingle, a text without words has none and is linked with nothing.

1. ``sketch``: every permutation gives two values, the smallest and the largest hash under it, so ``PERMUTATIONS``
   evaluations make twice as many values. Five values make a band; two sets of similarity 0.8 share none of the 30 bands
   with a chance of 7e-6. One byte of each value is kept to estimate similarities. Rows go by their number in the scan.
2. ``classes``: texts of equal sets (128 bits of sums and the size) are one class, represented by one row, that of its
   smallest doc_id. From here on only representatives count, so exact copies cost nothing however many there are.
   Classes that come under one doc_id are linked.
3. ``candidates``: representatives that share a band and whose estimate is at least ``ESTIMATE`` (4.5 standard deviations
   below 0.8) are connected, and each but the smallest of a connected part gives one link.
4. Clusters are the components of these links. Full sets are built anew for their members alone.
5. ``confirm``: within a cluster, the sizes of all intersections of a unit are counted from its shingles, and
   100 * intersection >= 80 * union decides. Connected parts give one link for each member again, so no link between
   different texts is lost, though copies are never expanded into pairs.
6. Components of the confirmed links give the answer; nothing is collected.

How a group (bucket or cluster) of any size meets (``meetings``): a small one is one unit of a task. A larger one is dealt
to strips of about ``BLOCK`` rows, or ``SHINGLES`` shingles, by hash, and ``LEADERS`` of its rows go to every strip. What is
alike is connected within strips and through the leaders, so most groups are one component by then. Rows of a group
that are outside its largest component meet all rows of it in a second pass, in blocks, so every pair that could still
connect something is compared, in a group of any size. Exchanged rows are those of the group, a few per cent for the
leaders, and some 4 * n * k / ``BLOCK`` for k rows outside the largest component; no row count is capped.

Defined cases: a null or empty text has no shingles, is its own component and is kept; a row with a null doc_id has its
shingles counted, a null component and is kept; rows of one doc_id, with equal or different texts, are in one component;
ties go to the smaller doc_id; a text of any length is one set, and a unit is bounded by its shingles; other columns are
ignored; an empty table gives an empty result. A table that is no scan of files is written first, since rows go by number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm.common import HOT, documents, handed, join_frequent, materialise, released
from spreadloom.llm.components import components
from spreadloom.llm.tokens import LONGEST, small_batches

SHINGLE = 5
PERMUTATIONS, ROWS = 75, 5
BANDS = 2 * PERMUTATIONS // ROWS
ESTIMATE = 98  # of 2 * PERMUTATIONS values
BLOCK = 1024
#: Shingles of a strip's full sets, 64 MiB on average.
SHINGLES = 1 << 23
#: Rows of a large group that go to all its strips.
LEADERS = 32
#: Rows of a unit's matrices that are worked on at once.
STRIP = 256
WORDS = 250_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Hashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: Hashes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(n, len(h))
    out = h[: len(h) - width + 1]
    for k in range(1, width):
        out = mix(out * _A + h[k : len(h) - width + 1 + k])
    return np.unique(mix(out + np.uint64(width)))


def multipliers() -> np.ndarray:
    return np.random.default_rng(8).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest, then the largest value under each permutation; 32 bits each."""
    low = high = None
    for k in range(0, len(hashes), 2048):
        values = (hashes[k : k + 2048, None] * factors) >> np.uint64(32)
        a, b = values.min(0), values.max(0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate([low, high]).astype(np.uint32)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, body) of a scan; the number of a row is the same in every pass."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, n, k1, k2, bands, sig) of every row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, factors = Hashes(), multipliers()
        for batch in small_batches(batches, "body"):
            n, k1, k2, signs = [], [], [], np.zeros((batch.num_rows, 2 * PERMUTATIONS), np.uint32)
            with np.errstate(over="ignore"):
                for row, body in enumerate(batch.column("body").to_pylist()):
                    found = shingles(body, words, shingle)
                    n.append(len(found))
                    k1.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                    k2.append(int(mix(found * _A).sum(dtype=np.uint64).view(np.int64)))
                    if len(found):
                        signs[row] = signature(found, factors)
                folded = np.zeros((batch.num_rows, BANDS), np.uint64)
                for k in range(ROWS):
                    folded = mix(folded * _A + signs.reshape(-1, BANDS, ROWS)[:, :, k] + np.uint64(k + 1))
                folded = mix(folded + np.arange(BANDS, dtype=np.uint64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, folded.size + 1, BANDS, dtype=np.int32)), pa.array(folded.view(np.int64).ravel()))
            sig = pa.array([r.tobytes() for r in signs.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), bands, sig], ["row", "doc_id", "n", "k1", "k2", "bands", "sig"])

    return numbered(docs).mapInArrow(run, "row long, doc_id long, n long, k1 long, k2 long, bands array<long>, sig binary")


def parts_of(links: np.ndarray) -> np.ndarray:
    """The smallest member of each row's connected part, from a symmetric matrix."""
    at = np.arange(len(links), dtype=np.int32)
    linked = links | np.eye(len(links), dtype=bool)
    while True:
        fresh = np.concatenate([np.where(linked[k : k + STRIP], at[None, :], np.int32(len(at))).min(1) for k in range(0, len(at), STRIP)])
        fresh = np.minimum(fresh, at)[np.minimum(fresh, at)]
        if (fresh == at).all():
            return at
        at = fresh


def single(table: pa.Table) -> pa.RecordBatch:
    """The rows of a table as one batch; columns that do not fit one are an error, never a loss of rows."""
    batches = table.combine_chunks().to_batches()
    if len(batches) != 1:
        raise OverflowError(f"{table.num_rows} rows do not fit one batch but {len(batches)}")
    return batches[0]


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal ``names``, which lie together, as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in names])
        cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi == lo:
                continue
            at = tuple(keys[:, lo].tolist())
            if at != last and held:
                yield single(pa.Table.from_batches(held)) if len(held) > 1 else held[0]
                held = []
            last = at
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield single(pa.Table.from_batches(held)) if len(held) > 1 else held[0]


def sized(rows: DataFrame, shingles: int | None = None) -> DataFrame:
    """Rows (grp, id, n) of groups of two and more, with ``cnt`` rows and the number of ``strips`` of their group; written."""
    sizes = rows.groupBy("grp").agg(F.count("*").alias("cnt"), F.sum("n").alias("mass")).where("cnt > 1")
    strips = F.ceil(F.col("cnt") / BLOCK)
    if shingles:
        strips = F.greatest(strips, F.ceil(F.col("mass") / shingles))
    return materialise(rows.join(sizes.select("grp", "cnt", strips.cast("int").alias("strips")), "grp"), "groups")


def strips(groups: DataFrame, shingles: int | None = None) -> DataFrame:
    """Units (grp, x, y, id, n) of the first pass: each row once, and the leaders of a large group in each of its strips."""
    own = F.pmod(F.xxhash64("id"), F.col("strips")).cast("int")
    plain = groups.select("grp", own.alias("x"), F.lit(0).alias("y"), "id", "n")
    large = groups.where("strips > 1")
    order = Window.partitionBy("grp").orderBy(F.xxhash64("id", F.lit(1)), "id")
    leaders = large.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= LEADERS)
    if shingles:
        mass = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        leaders = leaders.withColumn("_mass", mass).where((F.col("_mass") <= shingles) | (F.col("_rank") == 1))
    spread = leaders.withColumn("_own", own).select("grp", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("x"), F.lit(0).alias("y"), "id", "n", "_own")
    return plain.unionByName(spread.where("x <> _own").drop("_own"))


def rest(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (grp, id, n, strips, cnt, part, main, k) of large groups that are several components of ``found`` (node, component).

    ``main`` is a group's largest component and ``k`` the number of rows outside it; written.
    """
    placed = groups.where("strips > 1").join(handed(found.withColumnRenamed("node", "id"), found.count()), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    placed = materialise(placed, "placed")
    parts = placed.groupBy("grp", "part").agg(F.count("*").alias("c"))
    main = parts.groupBy("grp").agg(F.max_by("part", F.struct("c", "part")).alias("main"), (F.sum("c") - F.max("c")).alias("k"), F.count("*").alias("parts")).where("parts > 1")
    main = materialise(main.select("grp", "main", "k"), "main")
    return materialise(placed.join(handed(main, main.count()), "grp"), "rest")


def crossings(rows: DataFrame) -> DataFrame:
    """Units (grp, x, y, id, n) of the second pass: rows outside a group's largest component, in blocks x, meet all of it, in blocks y."""
    # a block is half a unit
    ys = 2 * F.col("strips")
    xs = F.ceil(F.col("k") * ys / F.col("cnt")).cast("int")
    rows = rows.withColumns({"_xs": xs, "_ys": ys})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = rows.where("part <> main").select("grp", F.pmod(F.xxhash64("id", F.lit(2)), F.col("_xs")).cast("int").alias("x"), every("_ys").alias("y"), "id", "n")
    inner = rows.select("grp", every("_xs").alias("x"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("_ys")).cast("int").alias("y"), "id", "n")
    # a row outside may come as one of all too; it is alike to itself, which links nothing
    return outer.unionByName(inner)


def meetings(groups: DataFrame, compare: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, shingles: int | None = None) -> DataFrame:
    """(node, component) of what ``compare`` finds alike in units of ``groups``, a table of ``sized``, and of ``known`` links."""
    links = compare(strips(groups, shingles))
    links = materialise(links if known is None else links.unionByName(known), "found")
    found = components(links)
    if groups.where("strips > 1").isEmpty():
        return found
    found = materialise(found, "components")
    left = rest(groups, found)
    if left.isEmpty():
        return found
    return components(links.unionByName(compare(crossings(left))))


def star(ids: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = parts_of(links)
    own = at != np.arange(len(at))
    return ids[own], ids[at[own]]


def candidates(reps: DataFrame) -> DataFrame:
    """(node, component) of representatives (id, n, bands, sig) connected by a band that they share and by looking alike."""
    banded = sized(reps.select(F.explode("bands").alias("grp"), "id", "n"))
    return meetings(banded, lambda units: resembling(units, reps))


def resembling(units: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) of representatives of a unit whose estimates reach ``ESTIMATE``."""
    signed = units.join(reps.select("id", "sig"), "id")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for unit in runs(batches, ["grp", "x", "y"]):
            if unit.num_rows < 2:
                continue
            n = unit.column("n").to_numpy()
            signs = np.frombuffer(b"".join(unit.column("sig").to_pylist()), np.uint8).reshape(len(n), -1)
            agree = np.zeros((len(n), len(n)), np.uint8)
            for column in np.ascontiguousarray(signs.T):
                agree += column[:, None] == column[None, :]
            near = agree >= ESTIMATE
            for k in range(0, len(n), STRIP):
                own = n[k : k + STRIP, None]
                near[k : k + STRIP] &= 100 * np.minimum(own, n[None, :]) >= 80 * np.maximum(own, n[None, :])
            out.append(star(unit.column("id").to_numpy(), near))
            size += len(out[-1][0])
            if size >= 10_000:
                yield linked(out)
                out, size = [], 0
        yield linked(out)

    dealt = signed.select("grp", "x", "y", "id", "n", "sig").repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def linked(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs. Frequent shingles go through a matrix product, rare ones pair by pair."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    firsts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([firsts, [len(values)]]))
    out = np.zeros((n, n), np.float32)
    frequent = counts >= 16
    for lo in range(0, int(frequent.sum()), 2048):
        chosen = np.flatnonzero(frequent)[lo : lo + 2048]
        dense = np.zeros((n, len(chosen)), np.float32)
        at = np.repeat(firsts[chosen], counts[chosen]) + np.arange(counts[chosen].sum()) - np.repeat(np.cumsum(counts[chosen]) - counts[chosen], counts[chosen])
        dense[owner[at], np.repeat(np.arange(len(chosen)), counts[chosen])] = 1
        out += dense @ dense.T
    pairs = []
    for g in range(2, 16):
        rare = firsts[counts == g]
        if len(rare):
            own = owner[rare[:, None] + np.arange(g)]
            for i in range(g):
                for j in range(i + 1, g):
                    pairs.append(own[:, i] * n + own[:, j])
    whole = out.astype(np.int32)
    if pairs:
        more = np.bincount(np.concatenate(pairs), minlength=n * n).astype(np.int32).reshape(n, n)
        whole += more
        whole += more.T
    return whole


def confirm(docs: DataFrame, members: DataFrame, known: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, component) of members (id, n, grp) whose full sets are alike, and of ``known`` links; an id is the number of a row of ``docs``."""
    wanted = members.select("id").distinct()
    # up to a bound the ids are handed to all tasks instead of exchanged with the texts
    texts = numbered(docs).select(F.col("row").alias("id"), "body").join(handed(wanted, wanted.count()), "id", "left_semi")

    @released
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashes()
        for batch in small_batches(batches, "body"):
            with np.errstate(over="ignore"):
                sets = [shingles(x, words, shingle) for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "m", "hashes"])

    sets = texts.mapInArrow(build, "id long, m long, hashes binary").where("m > 0")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for unit in runs(batches, ["grp", "x", "y"]):
            if unit.num_rows < 2:
                continue
            hashes = [np.frombuffer(x, np.uint64) for x in unit.column("hashes").to_pylist()]
            n = np.array([len(h) for h in hashes])
            both = intersections(hashes)
            alike = np.zeros(both.shape, bool)
            for k in range(0, len(n), STRIP):
                some = both[k : k + STRIP].astype(np.int64)
                alike[k : k + STRIP] = 100 * some >= 80 * (n[k : k + STRIP, None] + n[None, :] - some)
            out.append(star(unit.column("id").to_numpy(), alike))
            size += len(out[-1][0])
            if size >= 10_000:
                yield linked(out)
                out, size = [], 0
        yield linked(out)

    def compare(units: DataFrame) -> DataFrame:
        joined = units.join(sets, "id").select("grp", "x", "y", "id", "hashes")
        dealt = joined.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "id")
        return dealt.mapInArrow(run, "a long, b long").distinct()

    return meetings(sized(members.select("grp", "id", "n"), SHINGLES), compare, known, SHINGLES)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    docs = docs if docs.inputFiles() else materialise(docs, "texts")
    sketches = materialise(sketch(docs, shingle), "sketches")
    real = sketches.where("n > 0 and doc_id is not null")
    keys = ["k1", "k2", "n"]
    least = real.groupBy(*keys).agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count("*").alias("copies"))
    classes = materialise(least.select(*keys, F.col("rep.row").alias("id"), F.col("rep.doc_id").alias("least_id"), F.col("copies").alias("c")), "classes")
    reps = materialise(real.withColumnRenamed("row", "id").join(classes.select("id"), "id", "left_semi").select("id", "n", "bands", "sig"), "reps")
    clusters = candidates(reps)
    members = materialise(reps.select("id", "n").join(clusters.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id"), "members")
    parts = materialise(confirm(docs, members, one_id(real, classes, keys), shingle), "parts")
    named = parts.withColumnRenamed("node", "id").join(classes.select("id", "least_id"), "id")
    named = named.join(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "component").select("id", "component_id")
    answer = classes.join(named, "id", "left").select("k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("component_id", "least_id").alias("component_id"), F.col("c").alias("n"))
    answer = materialise(answer, "answer")
    # one row for each class of more than one in HOT of the rows goes to all tasks
    own = join_frequent(real.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles")), answer, ["k1", "k2", "n_shingles"], real.count() // HOT)
    own = own.select("doc_id", "n_shingles", "component_id")
    rest = sketches.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_id(real: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) between the classes of the texts that come under one doc_id."""
    mixed = F.xxhash64(*keys)
    several = real.groupBy("doc_id").agg(F.min(mixed).alias("a"), F.max(mixed).alias("b")).where("a <> b").select("doc_id")
    found = real.join(several, "doc_id").select("doc_id", *keys).distinct().join(classes, keys).select("doc_id", "id")
    return found.join(found.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), shingle=2)


OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM w UNION SELECT e.y, r.m FROM r JOIN e ON r.doc_id = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m::BIGINT AS component_id, w.doc_id = c.m AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id
"""
