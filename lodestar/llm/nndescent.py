"""Near-duplicate vectors by NN-descent, with exact thresholds.

1. Balls. Vectors of one label that fall in one bucket of a fine sign hash are compared with the bucket's smallest id;
   those within half the threshold's angle join its ball. Two members of a ball always link, so a group of near copies
   becomes a few balls whose inner links are counted, not listed.
2. First lists. Balls' centres that share a bucket of one of several coarse sign hashes are compared; each keeps its
   nearest ones. A label has as many hashes as a pair at the threshold needs to meet with a chance of ``MEET``: the finer
   the buckets, the more. Large buckets are cut, so a centre offers a bounded number of pairs.
3. NN-descent. Each centre joins its neighbours and reverse neighbours with one another and offers what it finds to both
   ends. A list whose places are all links is enlarged, up to ``PLACES``. Rounds end when few links are new.
4. Dense regions. A list of ``PLACES`` links is saturated: its centre may have any number of others. The component of
   found links that it is in is counted whole, block against block; what leaves a block is a count for each centre, pairs
   of balls that their radii leave open, and one link between parts that were not yet known to be linked.
5. Links. Two balls link wholly if their radii allow no exception; otherwise their members are compared in double
   precision, in blocks, and only counts leave the block.
6. Audit. For a bounded sample, half of all vectors and half of the balls' centres, links are counted by brute force
   against all rows; the sample grows until enough of its vectors have links. The recall is a mean over vectors, not
   links, and the least one of the strata by number of links, so a hot group does not hide the small ones. While it is
   below ``recall``, more hashes are added and the descent is repeated; after ``attempts``, as long as that raises it. A
   recall that is not reached, or that no sampled link could measure, is told in a warning, or raised where ``strict``.

Defined results. Vectors that are null, of length zero, or hold nulls or non-finite components, and rows without a label,
have no links; vectors of different lengths don't link. Rows that repeat an id get that id's result, from its first row
by value. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import together
from .graph import components
from .scratch import drop, save

BUCKET = 24  # vectors that a bucket of the first lists should hold
MEET = 0.99  # chance that two vectors at the threshold share a bucket of the first lists
FINE_BITS, FINE_ROUNDS = 14, 3
EPS = 1e-7
PLACES = 64  # of a list; one with as many links is saturated
WHOLE_BLOCK = 2048  # centres of a dense component that meet in one group


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _by_size(batch: pa.RecordBatch, column: str = "vec") -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Parts of a batch whose vectors have one length."""
    sizes = np.array([len(x) for x in batch.column(column)]) if batch.num_rows else np.zeros(0, int)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        part = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
        yield _matrix(part.column(column)), part


def _codes(vectors: DataFrame, tables: int, seed: int) -> DataFrame:
    """Adds ``codes``: for each table the signs of 31 random projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, part in _by_size(batch):
                planes = np.random.default_rng([seed, m.shape[1]]).normal(size=(m.shape[1], tables * 31))
                bits = (m @ planes > 0).reshape(len(m), tables, 31)
                code = (bits * (1 << np.arange(31))).sum(axis=2).astype(np.int64)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * tables, pa.int32()), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, codes], [*part.schema.names, "codes"])

    fields = ", ".join(f"{c} {k}" for c, k in vectors.dtypes)
    return vectors.mapInArrow(run, f"{fields}, codes array<long>")


def _limits(theta: float, radius: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least cosine of two centres at which members of their balls may still link."""
    return np.cos(np.minimum(np.pi, theta + radius[a][:, None] + radius[b][None, :])) - EPS


def _near(theta: float, keep: int) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Compare the centres of a group: the ``keep`` nearest of each, and what may link, ``PLACES`` in all at most."""

    def fn(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        ids, radius = group.column("id").to_numpy(), group.column("radius").to_numpy()
        m, label = _matrix(group.column("vec")), group.column("label").to_numpy(zero_copy_only=False)
        every = np.arange(len(ids))
        cos = np.clip(m @ m.T, -1, 1)
        cos[(ids[:, None] == ids[None, :]) | (label[:, None] != label[None, :])] = -2
        k = min(PLACES, len(ids))
        best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(cos, best, 1), axis=1, kind="stable"), 1)
        value = np.take_along_axis(cos, best, 1)
        link = value >= np.take_along_axis(_limits(theta, radius, every, every), best, 1)
        x, y = np.nonzero((link | (np.arange(k) < keep)) & (value > -1.5))
        out = [pa.array(ids[x]), pa.array(ids[best[x, y]]), pa.array(value[x, y]), pa.array(link[x, y])]
        return pa.RecordBatch.from_arrays(out, ["u", "v", "cos", "link"])

    return fn


def _lists(found: DataFrame, k: int) -> DataFrame:
    """Of each list the best ``k``, and links up to ``PLACES``."""
    both = found.union(found.select("v", "u", "cos", "link")).groupBy("u", "v").agg(F.max("cos").alias("cos"), F.max("link").alias("link"))
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("link"), F.desc("cos"), "v"))
    return both.withColumn("rank", rank).where(F.col("rank") <= PLACES).where(F.col("link") | (F.col("rank") <= k)).drop("rank")


def _balls(vectors: DataFrame, theta: float) -> tuple[DataFrame, DataFrame]:
    """Centres (``id``, ``label``, ``vec``, ``radius``, ``members``) and the centre of each vector (``vec_id``, ``id``)."""
    coded = save(_codes(vectors, FINE_ROUNDS, 1).withColumns({"radius": F.lit(0.0), "id": F.col("vec_id")}).drop("vec_id"), "coded")
    centres, moves = coded, []
    for t in range(FINE_ROUNDS):
        bucket = F.struct("label", F.size("vec").alias("dim"), F.col("codes")[t].bitwiseAND(F.lit((1 << FINE_BITS) - 1)).alias("code"))
        keyed = centres.withColumn("bucket", F.xxhash64(bucket))
        led = save(keyed.groupBy("bucket").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "leader"), "leaders")
        heads = keyed.join(led, keyed.id == led.leader).select(led.bucket, "leader", F.col("vec").alias("head"), F.col("label").alias("head_label"))
        heads = save(heads, "heads")
        pairs = keyed.join(heads, "bucket").where((F.col("id") != F.col("leader")) & (F.col("label") == F.col("head_label")) & (F.size("vec") == F.size("head")))
        moved = save(_angles(pairs.select("id", "leader", "vec", "head", "radius")).where(F.col("angle") + F.col("radius") <= theta / 2 - EPS), "moved")
        grown = moved.groupBy(F.col("leader").alias("grown")).agg(F.max(F.col("angle") + F.col("radius")).alias("reach"))
        left = centres.join(moved.select("id"), "id", "left_anti").join(grown, F.col("id") == F.col("grown"), "left")
        centres = save(left.withColumn("radius", F.greatest("radius", F.coalesce("reach", F.lit(0.0)))).drop("grown", "reach"), "centres")
        moves.append(moved.select(F.col("id").alias("from"), F.col("leader").alias("to")))
        for old in (led, heads):
            drop(old)
    home = coded.select(F.col("id").alias("vec_id"), "id")
    for move in moves:
        home = home.join(move, F.col("id") == F.col("from"), "left").select("vec_id", F.coalesce("to", "id").alias("id"))
    home = save(home, "home")
    size = home.groupBy("id").agg(F.count(F.lit(1)).alias("members"))
    return save(centres.drop("codes").join(size, "id"), "balls"), home


def _angles(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, part in _by_size(batch):
                cos = np.clip((m * _matrix(part.column("head"))).sum(axis=1), -1, 1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("leader"), part.column("radius"), pa.array(np.arccos(cos))], ["id", "leader", "radius", "angle"])

    kind = dict(pairs.dtypes)["id"]
    return pairs.mapInArrow(run, f"id {kind}, leader {kind}, radius double, angle double")


def _tables_for(bits: int, theta: float, least: int) -> int:
    """Hashes of that many bits that two vectors at an angle of ``theta`` need to share a bucket with a chance of ``MEET``."""
    return max(least, int(np.ceil(np.log(1 - MEET) / np.log(1 - (1 - theta / np.pi) ** min(bits, 31)))))


def _first_lists(balls: DataFrame, theta: float, tables: int, seed: int) -> DataFrame:
    size = balls.groupBy(F.col("label").alias("of_label")).agg(F.greatest(F.lit(1.0), F.ceil(F.log2(F.count(F.lit(1)) / BUCKET))).cast("int").alias("bits"))
    finest = size.agg(F.max("bits")).first()[0] or 1
    needed = F.element_at(F.array(*(F.lit(_tables_for(b, theta, tables)) for b in range(1, finest + 1))), F.col("bits"))
    coded = _codes(balls, _tables_for(finest, theta, tables), seed).join(size, F.col("label") == F.col("of_label"))
    spread = coded.withColumn("codes", F.slice("codes", F.lit(1), needed)).select("id", "of_label", F.size("vec").alias("dim"), "bits", F.posexplode("codes").alias("t", "code"))
    key = [F.col("of_label"), F.col("dim"), F.col("t"), F.expr("code & (shiftleft(1L, least(bits, 31)) - 1)")]
    kind = dict(balls.dtypes)["id"]
    return together(spread, key, _near(theta, 2), f"u {kind}, v {kind}, cos double, link boolean", balls.select("id", "label", "vec", "radius"), whole=False)


def _descend(balls: DataFrame, found: DataFrame, theta: float, k: int, rounds: int) -> DataFrame:
    """Lists after NN-descent from the pairs in ``found``."""
    lists = save(_lists(found, k), "lists")
    kind, links = dict(balls.dtypes)["id"], lists.where("link").count()
    for _ in range(rounds):
        edges = lists.select("u", "v").union(lists.select(F.col("v").alias("u"), F.col("u").alias("v")))
        members = edges.union(lists.select("u", F.col("u").alias("v"))).distinct()
        offered = together(members.withColumnRenamed("v", "id"), [F.col("u")], _near(theta, 2), f"u {kind}, v {kind}, cos double, link boolean", balls.select("id", "label", "vec", "radius"), whole=False)
        better = save(_lists(lists.union(offered), k), "lists")
        now = better.where("link").count()
        drop(lists)
        lists, before, links = better, links, now
        if now - before <= 0.001 * now:
            break
    return lists


def _members_between(balls: DataFrame, home: DataFrame, vectors: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """For pairs of balls (``u`` < ``v``) that may link: ``x``, its ``n`` links into the other ball, and the pair."""
    sides = pairs.select("u", "v", F.explode(F.array(F.struct(F.col("u").alias("ball"), F.lit(0).alias("side")), F.struct(F.col("v").alias("ball"), F.lit(1).alias("side")))).alias("s")).select("u", "v", "s.*")
    inside = home.select(F.col("id").alias("ball"), F.col("vec_id").alias("id"))
    kind = dict(balls.dtypes)["id"]

    def fn(group: pa.Table) -> pa.RecordBatch | None:
        a, b = (group.column(c).to_numpy(zero_copy_only=False) for c in "ab")
        side, ids, m = group.column("side").to_numpy(), group.column("id").to_numpy(), _matrix(group.column("vec"))
        hit = np.zeros(len(ids), np.int64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same_block = bool((a & b).all())
        linked = m[left] @ m[right].T >= cosine
        if not same_block:  # only across the two blocks
            linked &= a[left][:, None] != a[right][None, :]
        hit[left], hit[right] = linked.sum(axis=1), linked.sum(axis=0)
        some = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(hit[some]), *(group.column(c).combine_chunks().take(pa.array(some)) for c in "uv")], ["x", "n", "u", "v"])

    return together(sides.join(inside, "ball"), [F.col("u"), F.col("v")], fn, f"x {kind}, n long, u {kind}, v {kind}", vectors.select(F.col("vec_id").alias("id"), "vec"))


def _audit(vectors: DataFrame, centres: DataFrame, counted: DataFrame, cosine: float, sample: int, linked: int = 32, most: int = 4096) -> float | None:
    """Share of a vector's true links that were counted: the mean over the sample's vectors, in the stratum (powers of two
    of links) where it is least. The sample, half of it centres of balls, grows by four until ``linked`` of its vectors have
    links, it has ``most`` rows, or it is all rows. None if it is not and holds no link."""
    kind, rows = dict(vectors.dtypes)["vec_id"], vectors.count()
    while True:
        drawn = [r for x, n in ((vectors, sample - sample // 2), (centres, sample // 2)) for r in x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("vec_id", "label", "vec").collect()]
        truth = vectors.mapInArrow(_true_links(list({r.vec_id: r for r in drawn}.values()), cosine), f"vec_id {kind}, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
        share = F.least("n", F.coalesce("n_links", F.lit(0))) / F.col("n")
        strata = truth.where("n > 0").join(counted, "vec_id", "left").groupBy(F.floor(F.log2("n")).alias("stratum")).agg(F.avg(share).alias("share"), F.count(F.lit(1)).alias("seen"))
        found = strata.agg(F.min("share").alias("least"), F.sum("seen").alias("seen")).first()
        whole = sample // 2 >= rows
        if whole or sample >= most or (found.seen or 0) >= linked:
            return found.least if found.seen else 1.0 if whole else None
        sample = min(4 * sample, most)


def _true_links(asked: list, cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the links of each asked vector within a batch."""
    by_key: dict = {}
    for r in asked:
        by_key.setdefault((r.label, len(r.vec)), []).append(r)
    ready = {k: (np.array([r.vec_id for r in v]), np.array([r.vec for r in v], np.float64)) for k, v in by_key.items()}
    ready = {k: (i, m / np.sqrt((m * m).sum(axis=1, keepdims=True))) for k, (i, m) in ready.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, part in _by_size(batch):
                label, ids = part.column("label").to_numpy(zero_copy_only=False), part.column("vec_id").to_numpy()
                for (wanted, size), (q, qm) in ready.items():
                    rows = np.flatnonzero(label == wanted) if size == m.shape[1] else np.zeros(0, np.int64)
                    n = np.zeros(len(q), np.int64)
                    for at in range(0, len(rows), 1024):
                        some = rows[at : at + 1024]
                        n += ((qm @ m[some].T >= cosine) & (q[:, None] != ids[some][None, :])).sum(axis=1)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n)], ["vec_id", "n"])

    return run


def near_vectors(embeddings: DataFrame, cosine: float = 0.93, k: int = 8, tables: int = 16, rounds: int = 3, recall: float = 0.99, audit: int = 256, attempts: int = 3, strict: bool = False) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` and ``recall`` for every row of ``embeddings`` (``vec_id``, ``embedding``,
    ``label``). ``recall`` is what the audit found for the whole result, in all rows; null where no sampled vector has a link.
    If it is below the one that was asked after all attempts, that is a warning, or an error if ``strict``."""
    theta = float(np.arccos(cosine))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = embeddings.select("vec_id", F.col("embedding").alias("vec"), "label")
    vectors = save(rows.where("vec_id is not null and label is not null and vec is not null").where(whole).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.label", "x.vec"), "vectors")
    balls, home = _balls(vectors, theta)
    centres = balls.select(F.col("id").alias("vec_id"), "label", "vec")
    found, counted, linked, attempt, reached = None, None, None, 0, -1.0
    while True:
        start = _first_lists(balls, theta, tables, 10 + attempt)
        lists = _descend(balls, start if found is None else found.union(start), theta, k, rounds)
        for old in (found, counted, linked):
            if old is not None:
                drop(old)
        found = lists
        counted, linked = _count(vectors, balls, home, lists.where("link"), theta, cosine)
        attempt, before, reached = attempt + 1, reached, _audit(vectors, centres, counted, cosine, audit)
        if reached is None or reached >= recall:
            break
        if attempt >= attempts and reached <= before:
            break
    if reached is None or reached < recall:
        said = f"near_vectors: after {attempt} attempts " + ("no sampled vector has a link, so the recall is not known" if reached is None else f"the audit's recall is {reached:.4f}; {recall} was asked")
        if strict:
            raise RuntimeError(said)
        warnings.warn(said, stacklevel=2)
    group = components(linked.select(F.col("u").alias("a"), F.col("v").alias("b")))
    of = home.join(group, "id", "left").select("vec_id", F.coalesce("component", "id").alias("component_id"))
    known = save(of.join(counted, "vec_id", "left"), "known")
    for old in (vectors, balls, home, found, counted, linked):
        drop(old)
    out = embeddings.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(reached).cast("double").alias("recall"))


def _count(vectors: DataFrame, balls: DataFrame, home: DataFrame, near: DataFrame, theta: float, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Links of each vector, and pairs of balls that link and reach all that is linked."""
    pairs = near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cos").groupBy("u", "v").agg(F.max("cos").alias("cos"))
    side = lambda c: balls.select(F.col("id").alias(c), F.col("radius").alias(f"r{c}"), F.col("members").alias(f"m{c}"))
    sized = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("apart", F.acos(F.least(F.col("cos"), F.lit(1.0))))
    single = (F.col("ru") == 0) & (F.col("rv") == 0) & (F.col("mu") == 1) & (F.col("mv") == 1)
    kind = F.when(single & (F.col("cos") >= cosine), "all").when(single, "none").when(F.col("apart") + F.col("ru") + F.col("rv") <= theta - EPS, "all").otherwise("some")
    sized = save(sized.withColumn("kind", kind), "pairs")
    all_of, open_pairs = sized.where("kind = 'all'"), sized.where("kind = 'some'").select("u", "v")
    links, listed = all_of.select("u", "v"), all_of
    to_ball = None
    full = save(near.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PLACES).select(F.col("u").alias("id")), "saturated")
    if full.limit(1).count():
        inside = _dense(sized.select("u", "v"), full, links)
        made = save(_counted_whole(balls, inside, theta, cosine), "dense")
        listed = all_of.join(inside.select(F.col("id").alias("u")), "u", "left_anti")
        open_pairs = open_pairs.join(inside.select(F.col("id").alias("u")), "u", "left_anti").union(made.where("what = 'open'").select("u", "v"))
        links = links.union(made.where("what = 'link'").select("u", "v"))
        to_ball = made.where("what = 'count'").select(F.col("u").alias("id"), "n")
    some = save(_members_between(balls, home, vectors, open_pairs.distinct(), cosine), "between")
    from_lists = listed.select(F.col("u").alias("id"), F.col("mv").alias("n")).union(listed.select(F.col("v").alias("id"), F.col("mu").alias("n")))
    to_ball = (from_lists if to_ball is None else from_lists.union(to_ball)).groupBy("id").agg(F.sum("n").alias("n"))
    per_ball = balls.select("id", (F.col("members") - 1).alias("own")).join(to_ball, "id", "left").select("id", (F.col("own") + F.coalesce("n", F.lit(0))).alias("n"))
    per_member = some.groupBy(F.col("x").alias("vec_id")).agg(F.sum("n").alias("more"))
    counted = save(home.join(per_ball, "id").join(per_member, "vec_id", "left").select("vec_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_links")), "counted")
    linked = save(links.union(some.select("u", "v")).distinct(), "linked")
    for old in (sized, full, some):
        drop(old)
    return counted, linked


def _dense(pairs: DataFrame, full: DataFrame, links: DataFrame) -> DataFrame:
    """``id``, ``component`` and ``part`` of the centres whose component of pairs that may link holds a saturated list;
    ``part`` is the component of the links that are known."""
    ends = lambda df: df.select(F.col("u").alias("a"), F.col("v").alias("b"))
    wide = components(ends(pairs))
    chosen = wide.join(full, "id", "left_semi").select("component").distinct()
    known = components(ends(links)).select("id", F.col("component").alias("part"))
    return save(wide.join(chosen, "component", "left_semi").join(known, "id", "left").select("id", "component", F.coalesce("part", "id").alias("part")), "inside")


def _counted_whole(balls: DataFrame, inside: DataFrame, theta: float, cosine: float) -> DataFrame:
    """All pairs of centres of a component, block against block: ``what`` is ``count`` (``n`` links of ``u``'s members into
    other balls), ``open`` (a pair that needs its members) or ``link`` (a link between two parts)."""
    kind = dict(balls.dtypes)["id"]

    def fn(group: pa.Table) -> pa.RecordBatch | None:
        ids, radius, members, part = (group.column(c).to_numpy() for c in ("id", "radius", "members", "part"))
        a, b = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False)) for c in "ab")
        m = _matrix(group.column("vec"))
        cos = np.clip(m[a] @ m[b].T, -1, 1)
        own = ids[a][:, None] == ids[b][None, :]
        lone = (radius == 0) & (members == 1)
        single = lone[a][:, None] & lone[b][None, :]
        both = radius[a][:, None] + radius[b][None, :]
        every = np.where(single, cos >= cosine, np.arccos(cos) + both <= theta - EPS) & ~own
        undecided = ~single & ~every & ~own & (cos >= _limits(theta, radius, a, b))
        met_twice = len(a) == len(b) and (a == b).all()  # a block with itself: each pair stands twice
        rows = [(ids[a], None, every @ members[b], "count")] + ([] if met_twice else [(ids[b], None, members[a] @ every, "count")])
        x, y = np.nonzero(undecided)
        low, high = np.minimum(ids[a][x], ids[b][y]), np.maximum(ids[a][x], ids[b][y])
        once = np.unique(np.stack([low, high], axis=1), axis=0)
        rows.append((once[:, 0], once[:, 1], np.zeros(len(once), np.int64), "open"))
        x, y = np.nonzero(every & (part[a][:, None] != part[b][None, :]))
        parts = np.stack([np.minimum(part[a][x], part[b][y]), np.maximum(part[a][x], part[b][y])], axis=1)
        first = np.unique(parts, axis=0, return_index=True)[1]
        rows.append((ids[a][x[first]], ids[b][y[first]], np.zeros(len(first), np.int64), "link"))
        tables = [
            pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.array(ids).type) if v is None else pa.array(v), pa.array(n.astype(np.int64)), pa.array([what] * len(u), pa.string())], ["u", "v", "n", "what"])
            for u, v, n, what in rows
        ]
        return pa.Table.from_batches(tables).combine_chunks().to_batches()[0]

    payload = balls.select("id", "vec", "radius", "members")
    return together(inside, [F.col("component")], fn, f"u {kind}, v {kind}, n long, what string", payload, block=WHOLE_BLOCK)
