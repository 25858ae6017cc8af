"""Near-duplicate detection by b-bit MinHash.

Method.  A document is the set of its distinct word shingles, each a 64-bit
hash.  Documents with equal sets form a class; one row per class goes on.  112
minima of a class make 28 band keys of 4 full minima each; of 1,024 further
minima a packed signature keeps one bit each, in sixteen 64-bit words.  Classes
sharing a band key are candidates; their similarity is estimated from the packed
words by bit counts, corrected for the chance of 1/2 that two bits agree by
accident, and what passes is confirmed on the full shingle sets.

No pair explosion.  In each bucket every member meets one centre only, the member
that meets most others over all its buckets; of the centres it meets, a member is
paired with the most similar one, and the confirmed pairs form components.  Then, in each
bucket that still holds several components, members of different components are compared.
Sets that link differ in size by a factor of 1 / limit at most, so a bucket is first cut by
levels of set size, each of which meets itself and the next only.  What is still larger than
``SPLIT`` isn't compared as it stands: its members get 200 keys of 12 further minima each, and
those that share one are compared, by level again.  Comparing is done in blocks of bounded
size, whose pairs are estimated in numpy and leave the block only when the estimate allows a
link.  The members of such buckets get a packed signature of 4,096 bits for it, from a second
reading of their texts: a group may hold a great many pairs just below the limit,
and the longer signature tells them apart.  So each candidate pair is either inside one
component, where its link would change nothing, or is compared: no cap.

At a Jaccard similarity of 0.8 a pair shares no band with probability 4e-7, and
an estimate 4.7 standard deviations low (below 0.712, or 0.756 of the longer
signature) drops one in 8e5; a pair of a bucket above ``SPLIT`` shares none of the 200 keys
with probability 7e-7.

Edge cases: null, empty or blank texts have empty sets and link with nothing;
fewer words than a shingle are one shingle; rows with equal sets (repeated rows
too) are one class; rows that repeat an id with different sets follow their own
sets; a very long text takes some 40 bytes of memory a word; a null id keeps its row, which takes the component of the rows with an equal
set that have an id, and stands alone (null, kept) if there are none.  Extra columns pass through
``drop_near_duplicates`` and are ignored by ``near_duplicates``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, bound_arrow, hash_runs, list_array, mix, pieces, spans, table, text_buffer, written
from tessera.llm.components import components

BANDS, ROWS = 28, 4
SIGNED = 1024
WORDS = SIGNED // 64
LONG = 4096
LONG_BANDS, LONG_ROWS = 200, 12
BLOCK, SPLIT = 1024, 8192
#: How far below the limit an estimate may lie: 4.7 standard deviations at 0.8.
MARGIN, LONG_MARGIN = 0.088, 0.0441
#: Of the first 1,024 bits of the longer one, which are looked at first: 5.6 of them.
FIRST_MARGIN = 0.105

_rng = np.random.default_rng(917)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_A32 = _rng.integers(0, 2**31, SIGNED, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B32 = _rng.integers(0, 2**32, SIGNED, dtype=np.uint32)
_C = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A32_LONG = _rng.integers(0, 2**31, LONG, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B32_LONG = _rng.integers(0, 2**32, LONG, dtype=np.uint32)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text."""
    starts, ends, first = spans(data, off, SPACE)
    words = hash_runs(data, starts, ends)
    total = np.zeros(len(words), np.uint64)
    for k in range(n):
        total[: len(words) - k] += words[k:] * _C[k]
    total = mix(total)
    out = []
    for i, j in zip(first[:-1], first[1:], strict=True):
        if j - i >= n:
            out.append(np.unique(total[i : j - n + 1]))
        elif j > i:  # the whole sequence is the one shingle
            short = (words[i:j] * _C[: j - i]).sum(dtype=np.uint64) + _C[32:33] * np.uint64(j - i)
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(values: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of each non-empty set under value * a + b, for each a and b, from
    the sets one after another."""
    at = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), len(a)), values.dtype)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(values * a[k] + b[k], at)
    return out


def signatures(values: np.ndarray, sizes: np.ndarray, a: np.ndarray = _A32, b: np.ndarray = _B32) -> np.ndarray:
    """One bit of each of the minima under a and b, packed in 64-bit words."""
    least = minima((values >> np.uint64(32)).astype(np.uint32), sizes, a, b)
    return np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31), axis=1, bitorder="little").view(np.uint64)


def band_keys(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    by = minima(values, sizes, _A, _B).reshape(-1, BANDS, ROWS)
    return mix((by * _C[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _C[40])


def estimate(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (words last)."""
    differ = np.bitwise_count(p ^ q).sum(axis=-1, dtype=np.int64)
    return 1 - 2 * differ / (64 * p.shape[-1])


_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>, bands array<long>"


def _sign(n: int):
    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for i, j in pieces(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
                sizes = np.array([len(s) for s in sets])
                full = sizes > 0
                h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                sig, bands = np.zeros((0, WORDS), np.uint64), np.zeros((0, BANDS), np.uint64)
                if full.any():
                    values = np.concatenate(sets)
                    at = (np.cumsum(sizes) - sizes)[full]
                    h1[full] = mix(np.add.reduceat(mix(values ^ _C[50]), at))
                    h2[full] = mix(np.add.reduceat(mix(values ^ _C[51]), at))
                    sig, bands = signatures(values, sizes[full]), band_keys(values, sizes[full])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), list_array(sig.ravel().view(np.int64), full * WORDS, pa.int64()), list_array(bands.ravel().view(np.int64), full * BANDS, pa.int64())],
                    ["doc_id", "n_shingles", "h1", "h2", "sig", "bands"],
                )

    return run


def _sets(n: int):
    """(node, shingles) of each text."""

    def run(batch):
        data, off = text_buffer(batch.column("text"))
        for i, j in pieces(off):
            sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), list_array(values.view(np.int64), np.array([len(s) for s in sets]), pa.int64())], ["node", "shingles"])

    return run


def _long_signatures(n: int):
    """(node, sig) of each text that has shingles."""

    def run(batch):
        data, off = text_buffer(batch.column("text"))
        for i, j in pieces(off):
            sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            if len(full):
                sig = signatures(np.concatenate(sets), sizes[full], _A32_LONG, _B32_LONG)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i).take(pa.array(full)), list_array(sig.ravel().view(np.int64), np.full(len(full), LONG // 64), pa.int64())], ["node", "sig"])

    return run


def _long_bands(n: int):
    """(node, keys) of each text that has shingles: keys of LONG_ROWS of the longer
    signature's minima each."""
    used = LONG_BANDS * LONG_ROWS

    def run(batch):
        data, off = text_buffer(batch.column("text"))
        for i, j in pieces(off):
            sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            if len(full):
                values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
                least = minima(values, sizes[full], _A32_LONG[:used], _B32_LONG[:used]).reshape(-1, LONG_BANDS, LONG_ROWS).astype(np.uint64)
                keys = mix((least * _C[:LONG_ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(LONG_BANDS, dtype=np.uint64) * _C[41])
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i).take(pa.array(full)), list_array(keys.ravel().view(np.int64), np.full(len(full), LONG_BANDS), pa.int64())], ["node", "keys"])

    return run


def _passing(limit: float):
    """In a block: the pairs of its rest side and its other side, of different
    components, whose estimate allows a similarity of ``limit``.  Two visitors meet in their
    own level.  A pair that shares several bands leaves the bucket of the first only, and a
    pair of two rest members one block."""
    a_b = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    first, least = max(0.0, limit - FIRST_MARGIN), max(0.0, limit - LONG_MARGIN)

    def run(block: pa.Table) -> pa.Table:
        key = block.column("key")[0].as_py()
        side, main, visitor = (block.column(c).to_numpy() for c in ("rest", "main", "visitor"))
        node, part = block.column("node").to_numpy(), block.column("part").to_numpy()
        sig = block.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        bands = block.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        x, y = np.flatnonzero(side), np.flatnonzero(~side)
        start = np.ascontiguousarray(sig[y, :WORDS])
        found = [np.zeros((2, 0), np.int64)]
        for i in x:
            at = np.flatnonzero((part[y] != part[i]) & (main[y] | (node[y] < node[i])) & ~(visitor[y] & visitor[i]))
            good = y[at[estimate(sig[i, :WORDS], start[at]) >= first]]
            good = good[estimate(sig[i], sig[good]) >= least]
            shared = bands[good] == bands[i]
            good = good[~shared.any(axis=1) | (bands[i, shared.argmax(axis=1)] == key >> 32) | ~(bands[i] == key >> 32).any()]
            found.append(np.stack([np.maximum(node[i], node[good]), np.minimum(node[i], node[good])]))
        pairs = np.concatenate(found, axis=1)
        return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=a_b)

    return run


def _open_levels(member: DataFrame) -> DataFrame:
    """Of members (key, node, part, level) those of keys with several parts, at home in their
    level and visiting the one below, with the number that meet there."""
    inside = member.groupBy("key", "part").agg(F.count("*").alias("n"))
    open_keys = inside.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("most")).where("parts > 1")
    found = member.join(open_keys.select("key", "most"), "key").withColumn("main", F.col("part") == F.col("most")).drop("most")
    every = found.withColumn("visitor", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("level", F.col("level") - F.col("visitor").cast("int"))
    count = lambda what: F.sum(what.cast("long"))
    sizes = every.groupBy("key", "level").agg(F.count("*").alias("size"), count(~F.col("visitor")).alias("homes"), count(~F.col("main")).alias("others")).where("homes > 0 and others > 0 and size > 1")
    return every.join(sizes.select("key", "level", "size"), ["key", "level"])


def _compared(placed: DataFrame, longer: DataFrame, limit: float) -> DataFrame:
    """The pairs (a, b) of members that meet in a level of a key and may link; longer: (node,
    sig, bands)."""
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    chunk = F.pmod(F.xxhash64("node"), chunks).cast("int")
    every = F.sequence(F.lit(0), chunks - 1)
    of = ["key", "level", "node", "part", "main", "visitor"]
    rest = placed.where("not main").select(*of, F.lit(True).alias("rest"), chunk.alias("i"), F.explode(every).alias("j"))
    other = placed.select(*of, F.lit(False).alias("rest"), F.explode(every).alias("i"), chunk.alias("j"))
    blocks = rest.unionAll(other).join(longer, "node")
    return blocks.groupBy("key", "level", "i", "j").applyInArrow(_passing(limit), "a long, b long")


BLOOM_BITS = 27


def _might_hold(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter (one hash) of a column ``node`` of ids, of 2 ** BLOOM_BITS bits
    whatever the input: 16 MiB are gathered and broadcast at most."""
    at = F.pmod(F.xxhash64("node"), F.lit(1 << BLOOM_BITS))
    words = nodes.groupBy(F.floor(at / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).alias("bits"))
    filled = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    rows = words.groupBy(F.floor(F.col("w") / 4096).alias("page")).agg(F.collect_list(F.struct((F.col("w") % 4096).cast("int").alias("w"), "bits")).alias("held"))
    for page, held in rows.toLocalIterator():
        for w, bits in held:
            filled[page * 4096 + w] = bits
    return filled.view(np.uint8)


def _of_texts(nodes: DataFrame, docs: DataFrame, kernel, schema: str) -> DataFrame:
    """What ``kernel`` makes of the texts of ``nodes``.  A filter of fixed size keeps
    other texts from being worked on; what it lets through by accident the join drops."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_might_hold(nodes))

    def run(batches):
        bits = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            keep = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(keep):
                yield from kernel(batch.select(["node", "text"]).take(pa.array(keep)))

    at = F.pmod(F.xxhash64(F.col("doc_id").alias("node")), F.lit(1 << BLOOM_BITS))
    made = docs.select(F.col("doc_id").alias("node"), "text", at.alias("at")).mapInArrow(run, schema)
    return made.join(nodes, "node", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b: class nodes) with Jaccard of at least percent / 100
    on full shingle sets.  Only texts that occur in a pair are split again."""
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    # an id that repeats with other texts names several sets: any of them may link
    sets = written(_of_texts(nodes, docs, _sets(n), "node long, shingles array<long>"), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("s") + F.size("t") - both)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of
    docs (doc_id long, text string); see the module's text for method and cases."""
    spark = docs.sparkSession
    bound_arrow(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = written(texts.mapInArrow(_sign(shingle), _SIGNED), "signed")
    classes = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = written(classes.where("node is not null"), "classes")
    every_band = classes.select("node", F.explode("bands").alias("key"))
    crowded = every_band.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(every_band.join(crowded, "key"), "buckets")
    # first: every member with the one that meets most others in all its buckets,
    # which in a group of edited copies is the text they come from
    met = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    centre = buckets.join(met, "node").groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("m"))).alias("c")).select("key", (-F.col("c.m")).alias("centre"))
    stars = buckets.join(centre, "key").where("node <> centre").select("node", "centre").distinct()
    floor = max(0.0, percent / 100 - MARGIN)
    sig = classes.select("node", "sig")
    stars = stars.join(sig.withColumnRenamed("sig", "p"), "node").join(sig.select(F.col("node").alias("centre"), F.col("sig").alias("q")), "centre")
    # one pair for each member, with the centre most like it: what it may have in
    # common with the others is seen in the second step
    best = stars.withColumn("near", _estimate()).where(F.col("near") >= floor).groupBy("node").agg(F.max_by("centre", F.struct("near", -F.col("centre"))).alias("centre"))
    stars = best.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
    source = texts.where("doc_id is not null")
    links = written(_confirmed(written(stars, "stars"), source, shingle, percent), "links")
    parts = written(components(links), "parts")
    # then: in buckets of several components, pairs across components
    limit = percent / 100
    level = F.floor(F.log("n_shingles") / math.log(1 / min(limit, 0.999)) + 1e-9) if limit > 0 else F.lit(0)
    known = classes.select("node", level.cast("long").alias("level")).join(parts, "node", "left").select("node", "level", F.coalesce("component", "node").alias("part"))
    placed = written(_open_levels(buckets.select("key", "node").join(known, "node")), "open")
    open_nodes = written(placed.select("node").distinct(), "open-nodes")
    half = F.transform("bands", lambda k: F.shiftright(k, 32).cast("int"))
    longer = written(_of_texts(open_nodes, source, _long_signatures(shingle), "node long, sig array<long>"), "longer").join(classes.select("node", half.alias("bands")), "node")
    across = _compared(placed.where(F.col("size") <= SPLIT), longer, limit)
    crowd = written(placed.where(F.col("size") > SPLIT).select("node").distinct(), "crowd")
    if not crowd.isEmpty():
        keys = written(_of_texts(crowd, source, _long_bands(shingle), "node long, keys array<long>").select("node", F.explode("keys").alias("key")), "keys")
        shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        again = written(_open_levels(keys.join(shared, "key").distinct().join(known, "node")), "open-again")
        across = across.unionAll(_compared(again, longer, limit))
    across = across.distinct()
    more = _confirmed(written(across, "across"), source, shingle, percent)
    parts = components(links.unionAll(more))
    # rows of a class take its component
    named = classes.select("h1", "h2", "node").join(parts, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _estimate():
    """The estimate of packed signatures p and q, on the JVM."""
    differ = sum((F.bit_count(F.col("p")[i].bitwiseXOR(F.col("q")[i])) for i in range(WORDS)), F.lit(0))
    return 1 - 2 * differ / F.lit(SIGNED)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that are near copies of a row with a smaller id; all
    columns stay.  Ids name documents: rows that repeat a kept id all stay."""
    kept = near_duplicates(docs, shingle, percent).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: 4-word shingles, 80 %."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM s),
both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_in JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(b) AS component_id, min(b) = doc_id AS kept FROM s JOIN reach ON a = doc_id GROUP BY doc_id, len(s)
"""
