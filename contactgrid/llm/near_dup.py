"""Near-duplicate classes of documents: BagMinHash bands, verified by multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.llm.common import bound_batches, free_worker_caches, materialize, spaced
from contactgrid.llm.components import components
from contactgrid.llm.shingles import WordHasher, bag_minhash, counted, mix, shingle_sets

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: Registers of a signature, and registers of a band. The registers are dealt to bands twice, in two orders.
REGISTERS, BAND_REGISTERS = 96, 6
#: Share of equal registers below which two documents of one band are taken for less than similar: at 0.8, nearly five standard deviations off.
LEAST_AGREEMENT = 0.6
#: Documents of one block of a leader's group in the second pass.
BLOCK = 256
#: Sets of ids of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 500_000


def _worded(docs: DataFrame) -> DataFrame:
    """doc_id, a, b (hash of the words), text: documents that have an id and words."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(F.col("text")).alias("text")).where("doc_id is not null and text <> ''")
    return d.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"), "text")


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a, b (hash of the words), signature, bands; only documents with words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_caches()
        hasher = WordHasher()
        order = np.concatenate([np.arange(REGISTERS), np.arange(REGISTERS).reshape(BAND_REGISTERS, -1).T.ravel()])
        for batch in batches:
            for start, n, h, r, c in shingle_sets(batch.column("text"), SHINGLE_WORDS, hasher):
                found = bag_minhash(h, r, c, n, REGISTERS)
                groups = found[:, order].astype(np.uint64).reshape(n, -1, BAND_REGISTERS)
                bands = np.zeros(groups.shape[:2], np.uint64) + np.arange(groups.shape[1], dtype=np.uint64)
                for k in range(BAND_REGISTERS):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + groups[:, :, k])
                has = np.bincount(r, minlength=n) > 0
                flat = pa.array(bands[has].view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, groups.shape[1], dtype=np.int32)), flat)
                keep = pa.array(np.flatnonzero(has) + start)
                ids = [batch.column(x).take(keep) for x in ("doc_id", "a", "b")]
                raw = pa.array([x.tobytes() for x in found[has]], pa.binary())
                yield pa.RecordBatch.from_arrays([*ids, raw, lists], ["doc_id", "a", "b", "signature", "bands"])

    return _worded(docs).mapInArrow(sign, "doc_id bigint, a bigint, b bigint, signature binary, bands array<bigint>")


def _bags(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, bag): the counted shingles of the documents of ids (id, a, b), of rows that share an id those of that text."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_caches()
        hasher = WordHasher()
        for batch in batches:
            for start, n, h, r, c in shingle_sets(batch.column("text"), SHINGLE_WORDS, hasher):
                cuts = np.searchsorted(r, np.arange(n + 1)).tolist()
                raw = [counted(h[x:y], c[x:y]).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, n), pa.array(raw, pa.binary())], ["id", "bag"])

    ids = materialize(ids, "candidates")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    d = _worded(docs).withColumnRenamed("doc_id", "id").join(few, ["id", "a", "b"]).select("id", "text")
    return d.dropDuplicates(["id"]).mapInArrow(bag, "id bigint, bag binary")


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two bags, as sorted sets, have a Jaccard similarity of THRESHOLD or more."""
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same >= THRESHOLD * (len(x) + len(y) - same)


def _similar(docs: DataFrame, pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs (a, b) of document ids whose multisets of shingles have a Jaccard similarity of THRESHOLD or more."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, pair in enumerate(zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)):
                if _alike(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in "ab"], ["a", "b"])

    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    bags = materialize(_bags(docs, first.select("id", F.col("hash.a"), F.col("hash.b")).join(ids, "id", "left_semi")), "bags")
    of = lambda c: bags.select(F.col("id").alias(c), F.col("bag").alias(f"bag_{c}"))
    return materialize(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "bag_a", "bag_b").mapInArrow(verify, "a bigint, b bigint"), "similar")


def _cells(rows: DataFrame) -> DataFrame:
    """Each row of a leader's group once for each block that it has to be in: leader, i, j, kind, left, right, and the row's id and component.

    rows: leader, id, component, major (whether of the leader's component), n_major, n_minor. The others of a group (minor)
    are held against all of it, in blocks of BLOCK documents, so that a group of any size is many groups of bounded size.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rows = rows.withColumns({"nb_major": blocks("n_major"), "nb_minor": blocks("n_minor")})
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("major"), F.col("nb_major")).otherwise(F.col("nb_minor"))).cast("int")
    rows = rows.withColumn("mine", mine)
    cell = lambda i, j, kind, left, right: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(kind).alias("kind"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    me = F.col("mine")
    for_major = F.transform(upto(F.col("nb_minor")), lambda i: cell(i, me, "minor-major", False, True))
    against_major = F.when(F.col("nb_major") > 0, F.transform(upto(F.greatest("nb_major", F.lit(1))), lambda j: cell(me, j, "minor-major", True, False)))
    as_left = F.transform(F.filter(upto(F.col("nb_minor")), lambda j: j > me), lambda j: cell(me, j, "minor-minor", True, False))
    as_right = F.transform(F.filter(upto(F.col("nb_minor")), lambda i: i < me), lambda i: cell(i, me, "minor-minor", False, True))
    own = F.array(cell(me, me, "minor-minor", True, True))
    cells = F.when(F.col("major"), for_major).otherwise(F.concat(F.coalesce(against_major, F.slice(own, 1, 0)), as_left, as_right, own))
    return rows.select("leader", "id", "component", F.inline(cells))


def _agreements(f: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each left row of a block the right rows of other components whose registers agree enough, the likest first."""
    sig = np.frombuffer(b"".join(f["signature"]), np.uint32).reshape(-1, REGISTERS)
    x, y = np.flatnonzero(f["left"].to_numpy()), np.flatnonzero(f["right"].to_numpy())
    part = f["component"].to_numpy()
    for i in x:
        others = y[part[y] != part[i]]
        agree = (sig[others] == sig[i]).mean(axis=1)
        yield i, others[np.argsort(-agree, kind="stable")[: int((agree >= LEAST_AGREEMENT).sum())]]


_KEY = ["leader", "i", "j", "kind"]
_PLACED = "leader bigint, i int, j int, kind string, id bigint, component bigint, left boolean, right boolean"


def _block_links(docs: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """Links (a, b) between documents of different components within a leader's group, enough to join all that are linked.

    Signatures alone go to the blocks first, and tell which documents of a block agree with any of another component there. Only
    these documents' bags go to that block, where pairs that agree are verified, unless links found before already
    join them; so only links leave, at most one for each document of a block.
    """

    def agreeing(f: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(f), bool)
        for i, others in _agreements(f):
            found[i] |= len(others) > 0
            found[others] = True
        return f.loc[found, [c.split()[0] for c in _PLACED.split(", ")]]

    def verify(f: pd.DataFrame) -> pd.DataFrame:
        bags = [np.frombuffer(x, np.uint64) for x in f["bag"]]
        ids = f["id"].to_numpy()
        _, part = np.unique(f["component"].to_numpy(), return_inverse=True)
        found = []
        for i, others in _agreements(f):
            for j in others:
                if part[i] != part[j] and _alike(bags[i], bags[j]):
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    part[part == part[j]] = part[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    dealt = _cells(rows).join(first.select("id", "signature"), "id")
    near = materialize(dealt.groupBy(*_KEY).applyInPandas(agreeing, _PLACED), "agreeing")
    if not near.limit(1).count():
        return near.select(F.col("id").alias("a"), F.col("id").alias("b"))
    ids = near.select("id").distinct()
    bags = materialize(_bags(docs, first.select("id", F.col("hash.a"), F.col("hash.b")).join(ids, "id", "left_semi")).join(first.select("id", "signature"), "id"), "open-bags")
    return near.join(bags, "id").groupBy(*_KEY).applyInPandas(verify, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document with its class: doc_id, class_id, the smallest doc_id of the class.

    Two documents are linked if the multisets of their five-word shingles have a weighted Jaccard similarity
    of 0.8 or more; classes are the components of links. Documents of equal words are one class by their
    hashes; one of them stands for all. Each of these has a BagMinHash signature; bands of
    registers that two have in common make them candidates (at 0.8 similarity, all but a few in ten thousand).
    In a bucket all are first verified against the smallest id, its leader. Where the documents that have been held against
    one leader are then still of several components, those not of the leader's are held against all of them in
    blocks, by their registers first; pairs that agree are verified on the spot. Pairs within a component are not looked
    at, and only links leave a block, so no pass emits all pairs of a group of copies, and none that matters is lost.

    A text of fewer than five words is one shingle. Null or blank text: a class of its own. Null doc_id: null
    class. Rows that share doc_id are one document, whose text is the one of the smallest hashes. No rows: no rows.
    Columns other than doc_id and text play no part.
    """
    bound_batches(docs.sparkSession)
    signed = materialize(_signatures(docs), "signatures")
    hash_ = F.struct("a", "b")
    own = materialize(signed.groupBy("doc_id").agg(F.min(hash_).alias("hash")), "own-texts")
    equal = materialize(own.groupBy("hash").agg(F.min("doc_id").alias("same")), "equal")
    of_same = materialize(own.join(equal, "hash").select("doc_id", "same"), "same")
    stands = equal.select("hash.a", "hash.b", F.col("same").alias("doc_id"))
    first = signed.join(stands, ["a", "b", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    first = materialize(first.select(F.col("doc_id").alias("id"), hash_.alias("hash"), "signature", "bands"), "first")
    members = first.select("id", F.explode("bands").alias("key"))
    leaders = members.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader")
    leaders = materialize(leaders, "leaders")
    members = materialize(members.join(leaders, "key").select("key", "id", "leader"), "members")
    pairs = materialize(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "first-pairs")
    links = _similar(docs, pairs, first)
    found = components(links)

    rows = materialize(members.select("leader", "id").distinct(), "grouped").join(found, "id", "left")
    rows = materialize(rows.select("leader", "id", F.coalesce("component", "id").alias("component")), "named")
    lead = rows.where("id = leader").select("leader", F.col("component").alias("lead"))
    rows = materialize(rows.join(materialize(lead, "leads"), "leader").withColumn("major", F.col("component") == F.col("lead")).drop("lead"), "led")
    sizes = rows.groupBy("leader").agg(F.sum(F.col("major").cast("long")).alias("n_major"), F.sum((~F.col("major")).cast("long")).alias("n_minor"))
    rows = materialize(rows.join(materialize(sizes.where("n_minor > 0"), "open-sizes"), "leader"), "open")
    more = materialize(_block_links(docs, rows, first), "more-links")
    if more.limit(1).count():
        found = components(links.unionByName(more))

    classes = of_same.join(found, F.col("same") == F.col("id"), "left").select("doc_id", F.coalesce("component", "same").alias("class_id"))
    classes = materialize(classes, "classes")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, one of each class: that of the smallest doc_id. Of rows that share its doc_id, the one whose words have the smallest hashes stays, as its class has them."""
    classes = materialize(near_duplicates(docs), "all-classes")
    gone = materialize(classes.where("doc_id <> class_id").select("doc_id").distinct(), "gone")
    gone_few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone_few, docs["doc_id"] == gone["doc_id"], "left_anti")
    repeated = materialize(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    n = repeated.count()
    if not n:
        return kept
    few = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    words = spaced(F.col("text"))
    rank = F.struct((words == "").alias("blank"), F.xxhash64(words).alias("a"), F.xxhash64(F.lit("second"), words).alias("b"), F.xxhash64(*docs.columns).alias("row"))
    once = kept.join(few, kept["doc_id"] == repeated["doc_id"], "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), rank).alias("one")).select("one.*")
    return kept.join(few, kept["doc_id"] == repeated["doc_id"], "left_anti").unionByName(once)
