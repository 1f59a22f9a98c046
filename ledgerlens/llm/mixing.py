"""Mixing sources to target weights by pivotal dependent rounding.

Every document is wanted ``target / source_size`` times. The whole part is certain;
the fraction is a mass in words (fraction times size). Two documents of a source meet
and one gives mass to the other, in a random direction whose odds keep both
expectations, until one holds none or a whole copy. Mass moves but is never lost.
Chunks of about ``FANIN`` documents fold in this way to one residual each; residuals
fold again, a reduction tree of shuffles, until a source has one left. That one is
rounded, and one document of the last chunk is turned over if this brings the source
nearer its target; what is missed is less than half a document.

Only DataFrame and SQL functions are used. Chunks are dealt by hashes, so a hot
source is as many chunks as it needs. All draws are hashes of the documents' keys:
reruns agree whatever the partitioning.

Defined cases: a null text has size 0; size 0 takes nothing. A null source is a source
of its own, ranked last. Rows with the same id, source and size are counted first and
then told apart by an ordinal, so repeated rows get a decision each. Above ``REPEATS``
of them the ordinals are made and matched in ranges, each by a task. No rows give no
rows. Columns other than id, source and text are not read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, fresh, staged, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
FANIN = 64
#: Rows with the same id, source and size that one task counts out or numbers.
REPEATS = 100_000

# Two documents meet: the one carried on (a) and the next (x).
_FOLD = """
aggregate(
  slice(items, 2, size(items)),
  named_struct('cur', items[0], 'done', CAST(array() AS
    array<struct<doc_id: {id_type}, size: bigint, k: bigint, copies: bigint>>)),
  (acc, x) -> transform(
    array(named_struct(
      'a', acc.cur,
      'gain', least(acc.cur.size - acc.cur.mass, x.mass),
      'loss', least(acc.cur.mass, x.size - x.mass),
      'draw', pmod(xxhash64(acc.cur.h, x.h), 1073741824) / 1073741824.0D)),
    t -> CASE
      WHEN t.draw * (t.gain + t.loss) < t.loss AND t.a.size - t.a.mass <= x.mass THEN
        named_struct('cur', {x_after_gain}, 'done', concat(acc.done, array({a_taken})))
      WHEN t.draw * (t.gain + t.loss) < t.loss THEN
        named_struct('cur', {a_after_gain}, 'done', concat(acc.done, array({x_left})))
      WHEN t.a.mass <= x.size - x.mass THEN
        named_struct('cur', {x_after_loss}, 'done', concat(acc.done, array({a_left})))
      ELSE
        named_struct('cur', {a_after_loss}, 'done', concat(acc.done, array({x_taken})))
    END)[0])
"""

# A source's last chunk: the residual is rounded to the nearer side, and then the one
# document whose turning over brings the source nearest to its target is turned.
_LAST = """
transform(
  array(named_struct('up', cur.mass * 2 >= cur.size)),
  t -> transform(
    array(named_struct(
      'rows', concat(done, array(named_struct('doc_id', cur.doc_id, 'size', cur.size, 'k', cur.k,
        'copies', cur.whole + IF(t.up, 1L, 0L)))),
      'owed', cur.mass - IF(t.up, cur.size, 0L))),
    u -> transform(
      array(array_min(transform(u.rows, (r, i) -> named_struct(
        'miss', abs(u.owed - IF(r.copies > cur.whole, -r.size, r.size)), 'i', i)))),
      best -> transform(u.rows, (r, i) -> IF(i = best.i AND best.miss < abs(u.owed),
        named_struct('doc_id', r.doc_id, 'size', r.size, 'k', r.k,
          'copies', IF(r.copies > cur.whole, r.copies - 1L, r.copies + 1L)),
        r)))[0])[0])[0]
"""


def _with_mass(row: str, mass: str) -> str:
    return (f"named_struct('h', {row}.h, 'doc_id', {row}.doc_id, 'size', {row}.size, "
            f"'k', {row}.k, 'whole', {row}.whole, 'mass', {mass})")


def _settled(row: str, extra: int) -> str:
    return (f"named_struct('doc_id', {row}.doc_id, 'size', {row}.size, 'k', {row}.k, "
            f"'copies', {row}.whole + {extra}L)")


def _fold(id_type: str) -> str:
    return _FOLD.format(
        id_type=id_type,
        x_after_gain=_with_mass("x", "x.mass - t.gain"), a_taken=_settled("t.a", 1),
        a_after_gain=_with_mass("t.a", "t.a.mass + t.gain"), x_left=_settled("x", 0),
        x_after_loss=_with_mass("x", "x.mass + t.loss"), a_left=_settled("t.a", 0),
        a_after_loss=_with_mass("t.a", "t.a.mass - t.loss"), x_taken=_settled("x", 1),
    )


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES
) -> DataFrame:
    """source, source_size, documents, target from rows of (source, size, m).

    The shares that exceed ``most`` times their source go back to the others by
    weight. Each round is one aggregate of two numbers over the table of sources; a
    round can only add capped sources, so the rounds end. Ranking sorts ranges of
    sources by themselves; one task only sees their counts.
    """
    order = F.col("source").asc_nulls_last()
    ranges = staged(
        sizes.groupBy("source").agg(
            F.sum(F.col("size") * F.col("m")).alias("source_size"),
            F.sum("m").alias("documents"),
        ).repartitionByRange(order).withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    totals = staged(
        ranges.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("weight", F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            ((F.col("first") + F.col("inside")) % len(weights) + 1).cast("int"),
        )).select("source", "source_size", "documents", "weight"),
        "mix-ranked",
    )
    cap = F.col("source_size") * F.lit(float(most))
    row = totals.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = (row[0] or 0) * share
    level, before = (wanted / row[1] if row[1] else 0.0), None
    while level != before:
        full = F.col("weight") * F.lit(level) >= cap
        row = totals.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not row[1]:
            break
        before, level = level, (wanted - (row[0] or 0.0)) / row[1]
    return totals.select(
        "source", "source_size", "documents",
        F.least(cap, F.col("weight") * F.lit(float(level))).alias("target"),
    )


def _counted(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """doc_id, source, size and the number m of rows that share them."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint").alias("size"),
    )
    return staged(
        rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-sizes"
    )


def _told_apart(counted: DataFrame) -> DataFrame:
    """Each row of ``counted`` m times, with k from 1 to m."""
    one = F.lit(1).cast("bigint")
    few = counted.where(F.col("m") <= REPEATS).withColumn("k", F.explode(F.sequence(one, "m")))
    many = counted.where(F.col("m") > REPEATS)
    ranges = many.agg(F.sum(F.ceil(F.col("m") / REPEATS))).first()[0]
    if not ranges:
        return few
    step = F.lit(REPEATS).cast("bigint")
    many = many.withColumn("first", F.explode(F.sequence(one, "m", step))).repartition(
        min(int(ranges), 10_000), "doc_id", "source", "size", "first")
    last = F.least(F.col("m"), F.col("first") + step - 1)
    return few.unionByName(many.withColumn("k", F.explode(F.sequence("first", last))).drop("first"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, k, source_size, target, copies, taken."""
    return _mix(_counted(docs, id_col, source_col, text_col), weights, share, most, seed)


def _mix(counted: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
         seed: int = 7) -> DataFrame:
    id_type = counted.schema["doc_id"].dataType.simpleString()
    targets = staged(source_targets(counted, weights, share, most), "mix-targets")
    wanted = _told_apart(counted).join(
        targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = staged(wanted.select(
        "source", "source_size", "target", "documents",
        F.xxhash64(F.lit(seed), "doc_id", "size", "k").alias("h"), "doc_id", "size", "k",
        F.floor(rate).alias("whole"),
        ((rate - F.floor(rate)) * F.col("size")).alias("mass"),
    ), "mix-wanted")

    labels = ["source", "source_size", "target"]
    shape = [*labels, "doc_id", "size", "k", "copies"]
    decided = [wanted.where("mass = 0").withColumn("copies", F.col("whole")).select(shape)]
    most_in_one = targets.agg(F.max("documents")).first()[0] or 0
    item = F.struct("h", "doc_id", "size", "k", "whole", "mass")
    left = wanted.where("mass > 0").select(
        *labels, item.alias("cur"), F.col("documents").alias("parts"))
    level = 0
    while True:
        parts = F.ceil(F.col("parts") / FANIN)
        left = left.withColumn("parts", parts).withColumn(
            "chunk", F.pmod(F.xxhash64(F.lit(level), "cur.h"), F.col("parts")))
        folded = staged(
            left.groupBy(*labels, "parts", "chunk")
            .agg(F.sort_array(F.collect_list("cur")).alias("items"))
            .select(*labels, "parts", F.expr(_fold(id_type)).alias("fold"))
            .select(*labels, "parts", "fold.cur", "fold.done"),
            "mix-fold",
        )
        # The last chunk of a source is settled by _LAST, below.
        decided.append(folded.where("parts > 1").select(*labels, F.inline("done")).select(shape))
        last = folded.where("parts = 1")
        decided.append(last.select(*labels, F.inline(F.expr(_LAST))).select(shape))
        left = folded.where("parts > 1").select(*labels, "cur", "parts")
        most_in_one, level = -(-most_in_one // FANIN), level + 1
        if most_in_one <= 1:
            break
    result = decided[0]
    for part in decided[1:]:
        result = result.unionByName(part)
    return result.withColumn("taken", F.col("copies") * F.col("size"))


def _numbered_in_ranges(rows: DataFrame, keys: list[str], text_col: str, to: str) -> DataFrame:
    """``rows`` numbered from 1 within ``keys``, by hash of the text.

    Ranges of the order, cut by row where texts are equal, number their own rows and
    add the counts of the ranges before.
    """
    h, row, part, n, first = (fresh(rows, c) for c in ("__h", "__row", "__part", "__n", "__first"))
    rows = staged(rows.withColumn(h, F.xxhash64(text_or_empty(text_col))).withColumn(
        row, F.monotonically_increasing_id()), "mix-repeated")
    ranges = max(2, 2 * -(-rows.count() // REPEATS))
    dealt = staged(rows.repartitionByRange(min(ranges, 10_000), *keys, h, row).withColumn(
        part, F.spark_partition_id()), "mix-ranges")
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(n)).withColumn(
        first, F.coalesce(F.sum(n).over(before), F.lit(0)))
    names = {c: fresh(rows, f"__of_{i}") for i, c in enumerate([*keys, part])}
    counts = counts.select(*[F.col(c).alias(a) for c, a in names.items()], first)
    same = F.lit(True)
    for c, a in names.items():
        same = same & F.col(c).eqNullSafe(F.col(a))
    inside = F.row_number().over(Window.partitionBy(*keys, part).orderBy(h, row))
    return dealt.withColumn(n, inside).join(F.broadcast(counts), same).withColumn(
        to, (F.col(first) + F.col(n)).cast("bigint")).drop(h, row, part, n, first, *names.values())


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
               text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    size, k, copies, id_, source, size_, k_ = (fresh(docs, c) for c in (
        "__size", "__k", "__copies", "__mix_id", "__mix_source", "__mix_size", "__mix_k"))
    keys = [id_col, source_col]
    counted = _counted(docs, id_col, source_col, text_col)
    chosen = staged(_mix(counted, **options)
                    .where("copies > 0").select("doc_id", "source", "size", "k", "copies"), "mix-chosen")
    # Rows that share id, source and size are numbered in a fixed order.
    numbers = Window.partitionBy(*keys, size).orderBy(F.xxhash64(text_or_empty(text_col)))
    sized = docs.withColumn(size, F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint"))
    hot = counted.where(F.col("m") > REPEATS).select(
        F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size_))
    many = None
    if not hot.isEmpty():
        same = (F.col(id_col).eqNullSafe(F.col(id_)) & F.col(source_col).cast("string").eqNullSafe(F.col(source))
                & (F.col(size) == F.col(size_)))
        many = _numbered_in_ranges(sized.join(F.broadcast(hot), same, "left_semi"), [*keys, size], text_col, k)
        sized = sized.join(F.broadcast(hot), same, "left_anti")
    numbered = sized.withColumn(k, F.row_number().over(numbers).cast("bigint"))
    if many is not None:
        numbered = numbered.unionByName(many)
    match = chosen.select(
        F.col("doc_id").alias(id_), F.col("source").alias(source),
        F.col("size").alias(size_), F.col("k").alias(k_),
        F.col("copies").alias(copies),
    )
    joined = numbered.join(
        match,
        F.col(id_col).eqNullSafe(F.col(id_))
        & F.col(source_col).cast("string").eqNullSafe(F.col(source))
        & (F.col(size) == F.col(size_)) & (F.col(k) == F.col(k_)),
    )
    return joined.select(
        *docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), copies))
    ).select(*docs.columns)
