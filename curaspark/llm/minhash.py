"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components.

Signatures take two permutations of the 32-bit universe of shingles: the first scatters a shingle once, the second
is circularly shifted by k for coordinate k, so one pass over a text's shingles gives every coordinate.

Candidates never come as all pairs of a bucket. Texts with equal shingle sets are one vertex from the start. Every
bucket that spans several components tests its members against one hub on full sets: its least doc_id at first,
later the text with least beyond the hub before. A pair (x, y) that is
left in different components is then ruled out or found through that hub h. Let A and E count what a text lacks of h
and has beyond h. If x and y share nothing beyond h, they have at most |h| - max(A) words in common and at least
|h| - min(A) + E + E together: pairs for which this bound stays under the limit need no test, and those few over it are
tested. All others share something beyond h, so they meet again in buckets by hub and shared shingle, without h; each
text enters only as many of them, rarest first, as the overlap it needs leaves open. Buckets of up to `SMALL` texts,
a bound that grows fourfold with each turn, then test their pairs across components, larger ones name a hub again, until every
bucket is one component: no link of a bucket is lost.

Defined results: null, empty and white-space texts have no shingles and stay alone; a text of fewer words than a
shingle has one shingle, the whole sequence; rows that repeat a doc_id are one vertex; rows without a doc_id take
the least doc_id of their equals, or null. Only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import Store, mix64, tidied, word_hashes
from curaspark.llm.components import components

SMALL = 64
BANDS, ROWS = 30, 5  # at a similarity of 0.8 a pair shares no band with probability 6.7e-6
#: Odd multipliers, any will do.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def _multiplier(i: int) -> np.uint64:
    return np.uint64((int(_ODD[i % 8]) + 2 * (i // 8) * 0x51ED27) % 2**64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of `width` words, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = len(h) - width + 1
    if n < 1:
        scale = np.array([_multiplier(i + width) for i in range(len(h))], np.uint64)
        return mix64((h * scale).sum(keepdims=True) + np.uint64(len(h)))
    acc = np.zeros(n, np.uint64)
    for i in range(width):
        acc += h[i : i + n] * _multiplier(i)
    return np.unique(mix64(acc))


def _permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit integers (in place)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coords: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least image of the once-permuted shingles under the second permutation shifted by k."""
    at = _permuted(shingles.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(coords, dtype=np.uint32)[:, None]
    out = np.full(coords, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(at), 512):
        np.minimum(out, _permuted(at[None, s : s + 512] + shifts, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    acc = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[6]
    for i, col in enumerate(sig.reshape(bands, rows).T.astype(np.uint64)):
        acc = mix64(acc + (col + np.uint64(1)) * _multiplier(i))
    return acc.view(np.int64)


def _signed(width: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["rep", "shingles"])

    return run


def _against_hub(percent: int):
    """Tests x against its hub: whether they link, sizes of the hub, of A and E, and the shingles to meet by."""
    schema = pa.schema([("hub", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_()), ("h", pa.int64()), ("lacks", pa.int64()), ("beyond", pa.int64()), ("crowd", pa.bool_()), ("hub_comp", pa.int64()), ("comp", pa.int64()), ("meet", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in schema]
            narrow = [batch.column(i).to_pylist() for i in (0, 1, 2, 5, 6, 7)]
            for hub, rep, many, crowd, hub_comp, comp, x, y in zip(*narrow, batch.column(3), batch.column(4), strict=True):
                own, centre = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(centre, own)
                inside = centre[np.minimum(at, len(centre) - 1)] == own
                same = int(inside.sum())
                linked = 100 * same >= percent * (len(own) + len(centre) - same)
                meet = own[~inside].view(np.int64) if many else np.zeros(0, np.int64)
                for col, value in zip(out, (hub, rep, len(own), linked, len(centre), len(centre) - same, len(own) - same, crowd, hub_comp, comp, meet), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


_TESTED = "hub long, rep long, n long, linked boolean, h long, lacks long, beyond long, crowd boolean, hub_comp long, comp long, meet array<long>"


def _tests(pairs: DataFrame, sets: DataFrame, percent: int, store: Store, turn: int) -> DataFrame:
    """Each pair (hub, rep) tested on full sets; shingles beyond the hub come only where a hub has a crowd to part."""
    pairs = store.save(pairs, f"pairs-{turn}")
    crowds = store.save(pairs.groupBy("hub").agg(F.count_if("crowd").alias("n")).where("n > 1").select("hub", F.lit(True).alias("many")), f"crowds-{turn}")
    left = pairs.join(crowds, "hub", "left").join(sets.select("rep", F.col("shingles").alias("x")), "rep")
    full = left.join(sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("y")), "hub")
    many = F.coalesce("many", F.lit(False)) & F.col("crowd")
    tested = full.select("hub", "rep", many.alias("many"), "x", "y", "crowd", "hub_comp", "comp").mapInArrow(tidied(_against_hub(percent)), _TESTED)
    tested = store.save(tested, f"tested-{turn}")
    store.drop(f"pairs-{turn}", f"crowds-{turn}")
    return tested


def _joined(links: DataFrame, labels: DataFrame | None, store: Store, name: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Labels after links between components, and which components got another label; None where nothing changed."""
    links = store.save(links.select(F.col("hub_comp").alias("a"), F.col("comp").alias("b")), name)
    if not links.limit(1).count():
        return labels, None
    delta = components(links, store, f"{name}-parts")
    if labels is None:
        return delta, delta
    moved = labels.join(delta.select(F.col("v").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("v", F.coalesce("new", "comp").alias("comp"))
    return store.save(moved.unionAll(delta), f"{name}-labels"), delta


def _turn_pairs(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Pairs of a turn: hubs of large buckets with every member, and pairs across components of small buckets."""
    live = members.join(hubs, "key")
    crowded = live.where("large and rep <> hub").select("hub", "rep", F.lit(True).alias("crowd"), "hub_comp", "comp")
    x, y = live.where("not large").alias("x"), live.where("not large").select("key", "rep", "n", "comp").alias("y")
    sized = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & sized
    few = x.join(y, across).select(F.col("x.rep").alias("hub"), F.col("y.rep").alias("rep"), F.lit(False).alias("crowd"), F.col("x.comp").alias("hub_comp"), F.col("y.comp").alias("comp"))
    return crowded.unionAll(few).groupBy("hub", "rep").agg(F.max("crowd").alias("crowd"), F.first("hub_comp").alias("hub_comp"), F.first("comp").alias("comp"))


def _mixed(around: DataFrame) -> DataFrame:
    """Hubs whose members are in several components, with the least of E - A over them, at most 0 (the hub's own)."""
    return around.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.least(F.lit(0), F.min(F.col("beyond") - F.col("lacks"))).alias("g")).where("lo < hi").select("hub", "g")


def _meetings(around: DataFrame, percent: int) -> DataFrame:
    """Buckets by hub and a shingle beyond it, of each text's rarest ones only: key, rep, n, far, comp.

    If x and y link and x lacks at least as much as y, the shared part beyond the hub has at least
    (100 A + percent (E + g) - (100 - percent) h) / (100 + percent) shingles, g the least E - A around the hub; with y
    lacking more it has no fewer. So x need only offer all but that many of its shingles beyond the hub, less one.
    """
    need = F.ceil((100 * F.col("lacks") + percent * (F.col("beyond") + F.col("g")) - (100 - percent) * F.col("h")) / (100 + percent))
    need = F.greatest(F.lit(1), need, F.ceil(percent * F.col("n") / 100) - (F.col("n") - F.col("beyond")))
    take = F.greatest(F.lit(0), F.col("beyond") - need + 1).cast("int")
    rows = around.select("hub", "rep", "n", take.alias("take"), "beyond", "comp", F.explode("meet").alias("s")).where("take > 0")
    often = rows.groupBy("hub", "s").agg(F.count("*").alias("c"), (F.min("comp") < F.max("comp")).alias("mixed"))
    ranked = rows.join(often, ["hub", "s"]).groupBy("hub", "rep", "n", "take", "beyond", "comp").agg(F.sort_array(F.collect_list(F.struct("c", "s", "mixed"))).alias("m"))
    return ranked.select("hub", "rep", "n", "beyond", "comp", F.explode(F.slice("m", F.lit(1), F.col("take"))).alias("m")).where("m.mixed").select(F.xxhash64("hub", "m.s").alias("key"), "rep", "n", F.col("beyond").alias("far"), "comp")


def _bound_pairs(tested: DataFrame, percent: int) -> DataFrame:
    """Buckets of two for pairs around a hub that may link though they share nothing beyond it."""
    near = tested.where(100 * (F.col("n") - F.col("beyond")) >= percent * F.col("n")).select("hub", "rep", "n", "comp", "h", "lacks", "beyond", "g")
    near = near.where(100 * (F.col("h") - F.col("lacks")) >= percent * (F.col("h") + F.col("beyond") + F.col("g")))
    x, y = near.alias("x"), near.alias("y")
    common = F.col("x.h") - F.greatest("x.lacks", "y.lacks")
    union = F.col("x.h") - F.least("x.lacks", "y.lacks") + F.col("x.beyond") + F.col("y.beyond")
    sized = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    both = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & sized & (100 * common >= percent * union))
    pairs = both.select(*(F.col(f"{w}.{c}").alias(f"{w}_{c}") for w in "xy" for c in ("rep", "n", "comp"))).distinct()
    ends = F.array(*(F.struct(*(F.col(f"{w}_{c}").alias(c) for c in ("rep", "n", "comp"))) for w in "xy"))
    return pairs.select(F.xxhash64("x_rep", "y_rep", F.lit("pair")).alias("key"), F.explode(ends).alias("m")).select("key", "m.rep", "m.n", F.lit(0).cast("long").alias("far"), "m.comp")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept.

    Documents link where 100 * |intersection| >= percent * |union| of their distinct shingles.
    """
    store = Store(docs.sparkSession, "minhash")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = store.save(texts.mapInArrow(tidied(_signed(shingle_words, bands, rows)), "doc_id long, n_shingles long, node binary, bands array<long>"), "signed")
    nodes = store.save(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.where("rep is not null").select("rep", "n", F.explode("bands").alias("key"))
    shared = store.save(banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("hi")).where("hub < hi").select("key", "hub"), "shared")
    members = store.save(banded.join(shared, "key").select("rep", "hub").distinct(), "banded")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = store.save(texts.join(wanted, "doc_id").mapInArrow(tidied(_sets(shingle_words)), "rep long, shingles binary"), "sets")
    pairs = members.where("rep <> hub").select("hub", "rep", F.lit(True).alias("crowd"), F.col("hub").alias("hub_comp"), F.col("rep").alias("comp"))

    labels, turn = None, 0
    while True:
        tested = _tests(pairs, sets, percent, store, turn)
        labels, delta = _joined(tested.where("linked and hub_comp <> comp"), labels, store, f"links-{turn}")
        around = tested.where("crowd")
        if delta is not None:
            around = around.join(delta.select(F.col("v").alias("comp"), F.col("comp").alias("new")), "comp", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new")
        around = store.save(around, f"around-{turn}")
        around = around.join(store.save(_mixed(around), f"mixed-{turn}"), "hub")
        turn += 1
        members = store.save(_meetings(around, percent).unionAll(_bound_pairs(around, percent)), f"members-{turn}")
        hubs = members.groupBy("key").agg(F.min_by(F.struct(F.col("rep").alias("hub"), F.col("comp").alias("hub_comp")), F.struct("far", "rep")).alias("h"), F.count("*").alias("size"), (F.min("comp") < F.max("comp")).alias("mixed"))
        hubs = store.save(hubs.where("mixed").select("key", "h.*", (F.col("size") > SMALL * 4 ** (turn - 1)).alias("large")), f"hubs-{turn}")
        store.drop(f"tested-{turn - 1}", f"around-{turn - 1}", f"mixed-{turn - 1}", *([f"members-{turn - 1}", f"hubs-{turn - 1}"] if turn > 1 else ["banded"]))
        if not hubs.limit(1).count():
            break
        pairs = _turn_pairs(members, hubs, percent)

    found = signed.where("node is not null").join(nodes.select("node", "rep"), "node").select("doc_id", "n_shingles", "rep")
    if labels is not None:
        found = found.join(labels, found.rep == labels.v, "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("rep"))
    alone = signed.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))
    return found.unionAll(alone).select("doc_id", "n_shingles", F.col("rep").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("rep")).alias("kept"))


def one_of_each_group(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that `near_duplicates` keeps, with all their columns; rows that repeat a doc_id stay or go together."""
    own, name = {c.lower() for c in docs.columns}, "kept_id"
    while name in own:
        name += "_"
    kept = near_duplicates(docs, shingle_words, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
