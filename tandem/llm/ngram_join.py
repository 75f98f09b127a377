"""N-gram Jaccard self-join: MinHash banding finds candidates, full n-gram sets decide.

1. One pass gives each text a digest of its set of 5-word shingles, the set's size
   and its band hashes.  Bands and rows are chosen for a target recall at the
   threshold.
2. Texts with one set form a class, known by the digest; only one text of each goes
   on, so exact copies, however many, cost one row.
3. Sets are dealt by band hash.  Two rounds of the smallest label around a bucket
   give sets that share buckets a label, by aggregation and without pairs.  A label
   only says where sets are compared: near copies of one text mostly agree on it, so
   their sets travel once and not once for each of their buckets.
4. All sets of a label are compared exactly.  A bucket whose members have several
   labels is compared on its own as well: there a pair counts if its labels differ and
   no earlier band of the two agrees.  So every pair that shares a bucket is compared,
   and counted once.  What is larger than a block is cut into blocks, and each pair of
   blocks is one task's work.  Blocks grow before they become many, so that a large
   family's sets are not shuffled again and again; a task compares them tile by tile.
   It counts links per member and returns a spanning forest of them, never the pairs.
5. The forest's components are the classes of near duplicates.

Texts, bands and sets meet the few keys that ask for them behind a filter of bits
(``common.sift``), so whole texts are never shuffled, or, where rows are to go, only
those that may be such.

Keys that hold a large share of all rows (a bucket, a hub of the forest, a set that a
third of all documents have) meet their few partner rows by broadcast; ``join_spread``
says why those are bounded.  Comparing n different sets of one bucket costs n * n / 2
comparisons, as the exact number of links asks for.

Defined edge cases: a null or empty text, or one without words, has no shingles
and no links; a text of 1 to 4 words has one shingle, of all its words; a row
without id stays, with no class and no links; rows that share an id are rows of
their own: copies if their sets agree, else each with the class and links of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm import common

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Members of one block, and of the tiles in which a task compares larger ones; a set travels once for each block of its label or bucket.
BLOCK_ROWS = 192
#: From BLOCKS blocks on they grow instead, up to so many members or shingles; a task holds two blocks.
BLOCKS, MOST_ROWS, BLOCK_SHINGLES = 8, 4096, 1_500_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands, at most `most` hashes in all, find a pair at the threshold with this chance."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _sets(data_off, n: int, width: int = WIDTH):
    data, off = data_off
    start, end, row = common.words_of(data, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, rows, _ = common.shingles(common.Spans(data).hash(start, end), row, n, width)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[first], rows[first]


def _signatures(bands: int, rows_per: int, width: int):
    rng = np.random.default_rng(20240229)
    xors = rng.integers(0, 1 << 63, bands * rows_per, dtype=np.uint64)
    odds = rng.integers(0, 1 << 63, bands * rows_per, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, n in common.slices(text, common.SPAN_BYTES):
                hashes, row = _sets(common.utf8(text.slice(a, n)), n, width)
                size = np.bincount(row, minlength=n)
                begin = np.concatenate(([0], np.cumsum(size)))
                some = np.flatnonzero(size)
                keys = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    for j in range(bands):
                        for k in range(j * rows_per, (j + 1) * rows_per):
                            least = np.minimum.reduceat((hashes ^ xors[k]) * odds[k], begin[some])
                            keys[:, j] = common.mix(keys[:, j] * np.uint64(31) + least + np.uint64(j + 1))
                offsets = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), batch.column("mark").slice(a, n), _digests(hashes, begin, n), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))],
                    ["doc_id", "mark", "digest", "size", "bands"],
                )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of edges (a, b) with the smallest node that it is connected to.

    Each round sends every node the smallest label around it and then the label of that
    label, so paths shorten as they do in pointer jumping.
    """
    pairs = common.cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    # hubs: as many pairs end at a node as begin there
    degrees = common.cut(pairs.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least")))
    nodes, ends = degrees.agg(F.count(F.lit(1)), F.sum("n")).first()
    hubs = common.share_of(degrees, "node", total=ends or 0)
    labels, lower = degrees.select("node", F.least("least", "node").alias("root")), True
    while lower:
        around = common.join_spread(pairs.withColumnRenamed("b", "node"), labels, "node", hubs).groupBy("a").agg(F.min("root").alias("near"))
        step = common.cut(labels.join(around, labels.node == around.a, "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new")))
        # the label of the label; many nodes can have one label
        above = labels.select(F.col("node").alias("new"), F.col("root").alias("above"))
        popular = common.share_of(step.groupBy("new").agg(F.count(F.lit(1)).alias("n")), "new", total=nodes)
        lifted = common.join_spread(step, above, "new", popular, "left")
        new = common.cut(lifted.select("node", F.col("root").alias("old"), F.least("new", F.coalesce("above", "new")).alias("root")))
        lower = not new.where("old <> root").isEmpty()
        common.release(step, labels)
        labels = new
    common.release(pairs, degrees)
    return labels.select("node", "root")


def labelled_buckets(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mark, label) of the sets that share a bucket, and (band, bucket, mark, label, n, open) of the buckets with two sets or more.

    marks has mark and bands.  Two sets with one mark (64 bits of the digest) only
    share a label and their buckets' work.
    """
    members = marks.select("mark", F.posexplode("bands").alias("band", "b")).select("mark", "band", F.xxhash64("band", "b").alias("bucket"))
    full = common.cut(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("least")).where("n > 1"))
    hot = common.share_of(full, "bucket")
    met = common.cut(common.join_spread(common.sift(members, full, "bucket"), full.select("bucket", "n", "least"), "bucket", hot))
    near = met.groupBy("mark").agg(F.min("least").alias("label"))
    around = met.select("bucket", "mark").join(near, "mark").groupBy("bucket").agg(F.min("label").alias("near"))
    labels = common.cut(common.join_spread(met.select("bucket", "mark"), around, "bucket", hot).groupBy("mark").agg(F.min("near").alias("label")))
    of = met.select("bucket", "band", "mark", "n").join(labels, "mark")
    mixed = of.groupBy("bucket").agg((F.min("label") < F.max("label")).alias("open"))
    return labels, common.cut(common.join_spread(of, mixed, "bucket", hot))


def _digests(hashes: np.ndarray, begin: np.ndarray, n: int) -> pa.Array:
    out = [hashlib.blake2b(hashes[begin[i] : begin[i + 1]].tobytes(), digest_size=16).digest() if begin[i] < begin[i + 1] else None for i in range(n)]
    return pa.array(out, pa.binary())


def _texts_to_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, n in common.slices(text, common.SPAN_BYTES):
                hashes, row = _sets(common.utf8(text.slice(a, n)), n, width)
                begin = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([_digests(hashes, begin, n), lists], ["digest", "shingles"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets.

    Shingles that many sets hold are multiplied as 0/1 matrices, the rest are counted
    through the list of sets that hold each of them.
    """
    n, m = len(left), len(right)
    out = np.zeros((n, m), np.int64)
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    values = np.concatenate([*left, *right])
    owner = np.concatenate([np.repeat(np.arange(n), size_l), n + np.repeat(np.arange(m), size_r)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    end = np.concatenate((begin[1:], [len(values)]))
    in_left = np.add.reduceat((owner < n).astype(np.int64), begin) if len(begin) else begin
    in_right = end - begin - in_left
    both = (in_left > 0) & (in_right > 0)
    heavy = both & (in_left * in_right > 0.02 * n * m) & (in_left * in_right > 16)
    cols = np.flatnonzero(heavy)
    for k in range(0, len(cols), 2048):
        part = cols[k : k + 2048]
        a, b = np.zeros((n, len(part)), np.float32), np.zeros((m, len(part)), np.float32)
        for c, i in enumerate(part.tolist()):
            rows = owner[begin[i] : end[i]]
            cutoff = in_left[i]
            a[rows[:cutoff], c] = 1
            b[rows[cutoff:] - n, c] = 1
        out += np.rint(a @ b.T).astype(np.int64)
    flat, light = out.reshape(-1), np.flatnonzero(both & ~heavy)
    work = np.cumsum(in_left[light] * in_right[light])
    # all pairs of the sets that hold a shingle, a bounded number at a time
    for k in range(int(work[-1]) // 2_000_000 + 1 if len(work) else 0):
        some = light[np.searchsorted(work, k * 2_000_000, "right") : np.searchsorted(work, (k + 1) * 2_000_000, "right")]
        times = in_left[some] * in_right[some]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        wide, left_at, right_at = np.repeat(in_right[some], times), np.repeat(begin[some], times), np.repeat(begin[some] + in_left[some], times)
        flat += np.bincount(owner[left_at + at // wide] * m + owner[right_at + at % wide] - n, minlength=n * m)
    return out


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        rep, digest = table.column("rep").to_numpy(), np.array(table.column("digest").to_pylist(), object)
        by = np.lexsort((digest, rep))  # so that a row's place orders it as its name (rep, digest) does
        rep, digest = rep[by], digest[by]
        side, weight, label = (table.column(c).to_numpy()[by] for c in ("side", "n", "label"))
        sets = table.column("shingles").combine_chunks()
        off, values = np.asarray(sets.offsets), sets.values.to_numpy().view(np.uint64)
        rows = [values[off[i] : off[i + 1]] for i in by.tolist()]
        same, band = bool(table.column("same")[0].as_py()), table.column("band")[0].as_py()
        li, ri = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        got_n, got_root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        size, tiles = np.array([len(x) for x in rows]), []
        if band >= 0:
            bands = table.column("bands").combine_chunks().values.to_numpy().reshape(len(rep), -1)[by]
        for p in range(0, len(li), BLOCK_ROWS):
            for q in range(p if same else 0, len(ri), BLOCK_ROWS):
                tl, tr = li[p : p + BLOCK_ROWS], ri[q : q + BLOCK_ROWS]
                shared = intersections([rows[i] for i in tl], [rows[i] for i in tr])
                union = size[tl][:, None] + size[tr][None, :] - shared
                link = shared >= threshold * union - 1e-9
                own = same and p == q
                if own:
                    np.fill_diagonal(link, False)
                if band >= 0:  # a bucket of several labels: pairs of different labels whose first common band is this one
                    link &= (label[tl][:, None] != label[tr][None, :]) & (bands[tl, band][:, None] == bands[tr, band][None, :])
                    for k in range(band):
                        link &= bands[tl, k][:, None] != bands[tr, k][None, :]
                got_n[tl] += link @ weight[tr]
                if not own:
                    got_n[tr] += link.T @ weight[tl]
                if link.any():
                    tiles.append((tl, tr, link))
        # labels spread inside the blocks until they settle: a forest of at most one edge per member
        changed, top = True, len(rep)
        while changed:
            changed = False
            for tl, tr, link in tiles:
                new_l = np.minimum(got_root[tl], np.where(link, got_root[tr][None, :], top).min(axis=1, initial=top))
                changed |= bool((new_l != got_root[tl]).any())
                got_root[tl] = new_l
                new_r = np.minimum(got_root[tr], np.where(link, got_root[tl][:, None], top).min(axis=0, initial=top))
                changed |= bool((new_r != got_root[tr]).any())
                got_root[tr] = new_r
        keep = np.flatnonzero(got_n > 0)
        root = got_root[keep]
        bytes_of = lambda x: pa.array(x.tolist(), pa.binary())
        return pa.table({"rep": pa.array(rep[keep]), "digest": bytes_of(digest[keep]), "links": pa.array(got_n[keep]), "root_rep": pa.array(rep[root]), "root_digest": bytes_of(digest[root])})

    return run


def _blocks(members: Column, total: Column) -> Column:
    """Blocks for so many members with so many shingles in all."""
    return F.ceil(F.greatest(F.least(members / BLOCK_ROWS, F.lit(BLOCKS)), members / MOST_ROWS, total / BLOCK_SHINGLES)).cast("int")


def _mark(text: Column) -> Column:
    """A hash that tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _classes(docs: DataFrame, threshold: float, width: int, recall: float, id_col: str, text_col: str) -> DataFrame:
    """Every row of docs as (doc_id, mark, digest, root, class_id, n_links); digest and root, which names the class, are null without an id or without words."""
    common.small_batches(docs.sparkSession)
    bands, rows_per = bands_for(threshold, recall)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", _mark(F.col("text")))
    signed = common.cut(plain.mapInArrow(_signatures(bands, rows_per, width), "doc_id long, mark long, digest binary, size long, bands array<long>"))
    reps = common.cut(
        signed.where("doc_id is not null and size > 0")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "mark")).alias("row"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.first("bands").alias("bands"))
        .select("digest", F.col("row.doc_id").alias("rep"), F.col("row.mark").alias("text_mark"), "n", "size", "bands", F.xxhash64("digest").alias("mark"))
    )
    labels, buckets = labelled_buckets(reps.select("mark", "bands"))
    named = common.cut(common.sift(reps, labels, "mark").join(labels, "mark"))
    # the work: a label's sets, and the buckets with several labels
    blocks = _blocks(F.col("members"), F.col("total")).alias("blocks")
    span = common.cut(named.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total")).where("members > 1").select("label", "members", blocks))
    of_label = common.join_spread(named.select("mark", "digest", "label"), span.select("label", "blocks"), "label", common.share_of(span, "label", "members"))
    unit = lambda key, band: F.struct(key.alias("key"), band.cast("int").alias("band"), "blocks")
    inside = of_label.select("digest", unit(F.col("label"), F.lit(-1)).alias("u"))
    mixed = buckets.where("open").join(named.select("mark", "digest", "size"), "mark")
    wide = common.cut(mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total")).select("bucket", "members", blocks))
    across = common.join_spread(mixed.select("digest", "bucket", "band"), wide.select("bucket", "blocks"), "bucket", common.share_of(wide, "bucket", "members"))
    units = inside.unionByName(across.select("digest", unit(F.col("bucket"), F.col("band")).alias("u"))).groupBy("digest").agg(F.collect_list("u").alias("units"))  # at most one a band and one more
    asked = common.cut(named.join(units, "digest"))
    # texts that are not asked for and get through go when their sets meet the digests
    texts = common.sift(plain, asked.select(F.col("rep").alias("doc_id"), F.col("text_mark").alias("mark")), "doc_id", "mark").select("text")
    sets = texts.mapInArrow(_texts_to_sets(width), "digest binary, shingles array<long>").dropDuplicates(["digest"])
    work = (
        asked.join(sets, "digest")
        .withColumn("u", F.explode("units"))
        .withColumn("mine", F.pmod(F.xxhash64("digest", "u.key"), F.col("u.blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("u.blocks") - 1)))
        .select("u.key", "u.band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "digest", "n", "label", F.when(F.col("u.band") >= 0, F.col("bands")).alias("bands"), "shingles")
        .withColumns({"side": (F.col("mine") != F.col("i")).cast("int"), "same": F.col("i") == F.col("j")})
    )
    found = common.cut(work.groupBy("key", "band", "i", "j").applyInArrow(_verify(threshold), "rep long, digest binary, links long, root_rep long, root_digest binary"))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    # a set's name is its least id and its digest, so the least name of a component begins with its least id
    edges = found.select(F.struct("rep", "digest").alias("a"), F.struct(F.col("root_rep").alias("rep"), F.col("root_digest").alias("digest")).alias("b")).where("a <> b")
    roots = components(edges).select("node.digest", F.col("root.rep").alias("class_id"), F.col("root.digest").alias("root"))
    classes = reps.select("digest", "rep", "n").join(links, "digest", "left").join(roots, "digest", "left")
    classes = common.cut(classes.select("digest", "n", F.coalesce("root", "digest").alias("root"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    some = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    rows = common.join_spread(signed.where(some).select("doc_id", "mark", "digest"), classes.drop("n"), "digest", common.share_of(classes, "digest"))
    bare = signed.where(~some).select("doc_id", "mark", *[F.lit(None).cast("binary").alias(c) for c in ("digest", "root")], F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.select("doc_id", "mark", "digest", "root", "class_id", "n_links").unionByName(bare)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class) and n_links.

    n_links counts the other rows whose n-gram sets are at least `threshold` alike,
    exact copies included; a class is a connected component of these links.
    """
    return _classes(docs, threshold, width, recall, id_col, text_col).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, and all rows without id or without words.

    The row with the class's smallest id stays; where several rows have that id, the
    one whose text hashes lowest, and of rows that agree in id and text the one that
    hashes lowest as a whole.
    """
    rows = _classes(docs, threshold, WIDTH, RECALL, id_col, text_col).where("doc_id is not null and digest is not null")
    texts = common.cut(rows.groupBy("doc_id", "mark", "root", "class_id").agg(F.count(F.lit(1)).alias("n")))
    # of several texts under the smallest id of a class the least one by hash
    least = texts.where("doc_id = class_id").groupBy("root").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least < most").select("root", "least")
    spare = (F.col("doc_id") != F.col("class_id")) | F.coalesce(F.col("mark") > F.col("least"), F.lit(False))
    judged = texts.join(least, "root", "left").select("doc_id", "mark", spare.alias("spare"), "n").where("spare or n > 1")
    key, mark, gone, whole = common.fresh(docs, "key", "mark", "gone", "whole")
    judged = common.cut(judged.select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("spare").alias(gone)))
    marked = docs.withColumns({key: F.col(id_col).cast("long"), mark: _mark(F.col(text_col))})
    hashed = [c for c, t in docs.dtypes if "map<" not in t]
    # only rows that may be judged are shuffled with their texts
    asked = common.flagged(marked, judged, whole, key, mark)
    alone = asked.where(~F.col(whole)).select(*docs.columns)
    kept = asked.where(whole).join(judged, [key, mark], "left_anti").select(*docs.columns)
    several = judged.where(~F.col(gone)).select(key, mark)
    repeats = common.sift(marked, several, key, mark).join(several, [key, mark], "left_semi").groupBy(key, mark).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias(whole)).select(f"{whole}.*")
    return alone.unionByName(kept).unionByName(repeats)
