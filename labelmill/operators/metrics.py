"""Scores of labels against gold labels, inter-rater agreement and column summaries.

All label scores of a run come from one aggregate with map-side partial sums; ``by`` gives one result per run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, GroupedData, functions as F, types as T

from labelmill.functions.sql_text import name, value, values
from labelmill.operators.positions import running


def _hit(gold: str, pred: str) -> str:
    return f"coalesce({name(gold)} = {name(pred)}, false)"


def _share(part: str, whole: str) -> str:
    """part / whole as double, 0 where there is nothing to divide by."""
    return f"if({whole} = 0, 0D, double({part}) / ({whole}))"


def accuracy(df: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return _accuracy_of(df.groupBy(*by), gold, pred)


def accuracy_by_label(
    df: DataFrame, gold: str, pred: str, labels: Sequence | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Share of hits among the rows of each gold label, null for a listed label no row has."""
    if labels is None:
        counted = df.where(F.col(gold).isNotNull()).groupBy(*by, F.col(gold).alias("label"))
        return _accuracy_of(counted, gold, pred)
    sums, rows = [], []
    for place, label in enumerate(labels):
        mine = f"{name(gold)} = {value(label)}"
        sums.append(F.expr(f"count_if({mine}) AS n{place}"))
        sums.append(F.expr(f"count_if({mine} AND {_hit(gold, pred)}) AS hits{place}"))
        share = f"if(n{place} > 0, double(hits{place}) / n{place}, NULL)"
        rows.append(f"struct({value(label)} AS label, n{place} AS n, {share} AS accuracy)")
    return df.groupBy(*by).agg(*sums).select(*by, F.expr(f"inline(array({', '.join(rows)}))"))


def _accuracy_of(groups: GroupedData, gold: str, pred: str) -> DataFrame:
    return groups.agg(F.count("*").alias("n"), F.expr(f"avg(int({_hit(gold, pred)}))").alias("accuracy"))


def confusion_matrix(df: DataFrame, gold: str, pred: str, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """One row per gold label and one column per predicted label, both in list order; other pairs are left out."""
    # Rows are counted by pair; the short result is spread over the labels.
    pairs = df.where(F.col(name(gold)).isin(*labels) & F.col(name(pred)).isin(*labels))
    counted = pairs.groupBy(*by, F.col(name(gold)).alias("_gold"), F.col(name(pred)).alias("_pred")).agg(F.count("*").alias("_n"))
    lines = df.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > 0).select(
        *by, F.posexplode(F.array(*[F.lit(label) for label in labels])).alias("_place", "_label")
    )
    cells = [F.sum(F.when(F.col("_pred") == F.lit(said), F.col("_n"))).alias(f"_c{place}") for place, said in enumerate(labels)]
    counts = counted.groupBy(*by, "_gold").agg(*cells).withColumnsRenamed({key: f"_of_{key}" for key in by})
    test = (lines["_label"] == counts["_gold"])
    for key in by:
        test &= lines[key].eqNullSafe(counts[f"_of_{key}"])
    joined = lines.join(counts, test, "left")
    shown = [F.coalesce(F.col(f"_c{place}"), F.lit(0)).cast("long").alias(str(said)) for place, said in enumerate(labels)]
    return joined.select(*by, F.col("_place").cast("long").alias("ordinal"), F.col("_label").alias("label"), *shown)


REPORT_FIELDS = ("ordinal", "label", "precision", "recall", "f1", "support")


def _line(target: str | None, *values: str) -> str:
    fields = [f"{text} AS {field}" for text, field in zip(values, REPORT_FIELDS)]
    return f"struct({', '.join(fields if target is None else [f'{value(target)} AS target', *fields])})"


def classification_report(
    df: DataFrame, gold: str, pred: str, labels: Sequence | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Long report: a row per label, then ``accuracy`` or ``micro avg``, ``macro avg`` and ``weighted avg``.

    ``accuracy`` stands when every gold label and prediction is listed. A null prediction is a wrong one that belongs to
    no label. Without ``labels`` the labels are those seen in either column, and ``accuracy`` always stands.
    """
    if labels is None:
        return _open_report(df, gold, pred, by)
    return target_reports(df, {None: (gold, pred, labels)}, by)


def target_reports(
    df: DataFrame, targets: Mapping[str | None, tuple[str, str, Sequence]], by: Sequence[str] = (), weight: str | None = None,
) -> DataFrame:
    """Reports of several (gold, predicted, labels) targets from one pass over the rows, with a ``target`` column when
    the targets have names. A row may stand for ``weight`` equal ones."""
    sums, lines = [], []
    for number, (name, (gold, pred, labels)) in enumerate(targets.items()):
        sums += _report_sums(f"_{number}", gold, pred, labels, weight)
        lines += _report_lines(f"_{number}", name, [str(label) for label in labels])
    return df.groupBy(*by).agg(*sums).select(*by, F.expr(f"inline(array({', '.join(lines)}))"))


def _report_sums(mark: str, gold: str, pred: str, labels: Sequence, weight: str | None = None) -> list[Column]:
    def times(test: str) -> str:
        return f"count_if({test})" if weight is None else f"coalesce(sum(if({test}, {name(weight)}, 0L)), 0L)"

    true, said, listed = name(gold), name(pred), values(labels)
    known = f"coalesce({true} IN ({listed}), false) AND coalesce({said} IN ({listed}), false)"
    sums = {"n": times("true"), "hits": times(f"{true} = {said}"), "outside": times(f"NOT ({known})")}
    for place, label in enumerate(labels):
        sums[f"tp{place}"] = times(f"{true} = {value(label)} AND {said} = {value(label)}")
        sums[f"pred{place}"] = times(f"{said} = {value(label)}")
        sums[f"sup{place}"] = times(f"{true} = {value(label)}")
    return [F.expr(f"{text} AS {mark}_{key}") for key, text in sums.items()]


def _report_lines(mark: str, target: str | None, listed: list[str]) -> list[str]:
    """The rows of one report as SQL structs over the sums of :func:`_report_sums`."""
    places = range(len(listed))
    tp, said, support = ([f"{mark}_{key}{place}" for place in places] for key in ("tp", "pred", "sup"))
    scores = [
        [_share(tp[i], said[i]) for i in places],
        [_share(tp[i], support[i]) for i in places],
        [_share(f"2 * {tp[i]}", f"{said[i]} + {support[i]}") for i in places],
    ]
    hits, all_said, rows = (f"({' + '.join(parts)})" for parts in (tp, said, support))
    listed_only = f"{mark}_outside = 0"
    share = _share(f"{mark}_hits", f"{mark}_n")
    overall = [_share(hits, all_said), _share(hits, rows), _share(f"2 * {hits}", f"{all_said} + {rows}")]
    lines = [
        _line(target, f"{i}L", value(label), *[score[i] for score in scores], support[i]) for i, label in enumerate(listed)
    ]
    lines.append(
        _line(
            target, f"{len(listed)}L", f"if({listed_only}, 'accuracy', 'micro avg')",
            *[f"if({listed_only}, {share}, {score})" for score in overall], rows,
        )
    )
    macro = [f"({' + '.join(score)}) / {len(listed)}" for score in scores]
    weighted = [_share(" + ".join(f"{score[i]} * {support[i]}" for i in places), rows) for score in scores]
    lines.append(_line(target, f"{len(listed) + 1}L", "'macro avg'", *macro, rows))
    lines.append(_line(target, f"{len(listed) + 2}L", "'weighted avg'", *weighted, rows))
    return lines


def _open_report(df: DataFrame, gold: str, pred: str, by: Sequence[str]) -> DataFrame:
    by = list(by)
    pairs = df.groupBy(*by, F.col(gold).alias("_gold"), F.col(pred).alias("_said")).agg(F.count("*").alias("_n"))
    roles = F.expr(
        "inline(array(struct(_gold AS label, if(_gold <=> _said, _n, 0L) AS tp, 0L AS said, _n AS support),"
        " struct(_said AS label, 0L AS tp, _n AS said, 0L AS support)))"
    )
    counts = pairs.select(*by, roles).where("label IS NOT NULL").groupBy(*by, "label")
    counts = counts.agg(F.sum("tp").alias("tp"), F.sum("said").alias("said"), F.sum("support").alias("support"))
    scores = {"precision": ("tp", "said"), "recall": ("tp", "support"), "f1": ("2 * tp", "said + support")}
    per_label = counts.select(
        *by, F.expr("0L AS ordinal"), F.expr("string(label) AS label"),
        *[F.expr(f"{_share(part, whole)} AS {score}") for score, (part, whole) in scores.items()], "support", "tp",
    )
    averages = per_label.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("n"),
        *[F.expr(f"avg({score}) AS macro_{score}") for score in scores],
        *[F.expr(f"sum({score} * support) AS weighted_{score}") for score in scores],
    )
    lines = [
        _line(None, "1L", "'accuracy'", *[_share("tp", "n")] * 3, "n"),
        _line(None, "2L", "'macro avg'", *[f"macro_{score}" for score in scores], "n"),
        _line(None, "3L", "'weighted avg'", *[_share(f"weighted_{score}", "n") for score in scores], "n"),
    ]
    return per_label.drop("tp").unionByName(averages.select(*by, F.expr(f"inline(array({', '.join(lines)}))")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def distinct_values(*tables: tuple[DataFrame, str]) -> DataFrame:
    """The values seen in any of the (table, column) pairs."""
    seen = tables[0][0].select(F.col(tables[0][1]).alias("label"))
    for table, column in tables[1:]:
        seen = seen.unionByName(table.select(F.col(column).alias("label")))
    return seen.distinct()


def rating_table(df: DataFrame, keep: Sequence[str], raters: Sequence[str], categories: Sequence) -> DataFrame:
    """Subject by category counts of given ratings, computed inside the row."""
    given = f"array({', '.join(name(rater) for rater in raters)})"
    votes = [
        F.expr(f"bigint(size(filter({given}, rating -> rating = {value(category)}))) AS {name(str(category))}")
        for category in categories
    ]
    return df.select(*keep, *votes)


def rating_counts(df: DataFrame, subject: str, raters: Sequence[str]) -> DataFrame:
    """The same counts in long form, for categories that are not known beforehand, counted inside the row of each subject."""
    given = F.array_compact(F.array(*[F.col(rater) for rater in raters]))
    counts = F.transform(
        F.array_distinct(given), lambda label: F.struct(label.alias("label"), F.size(F.filter(given, lambda x: x == label)).cast("long").alias("n"))
    )
    return df.select(subject, F.inline(counts))


def fleiss_kappa(df: DataFrame, raters: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Agreement of the raters beyond chance, over the subjects all of them rated; the others are counted.

    Agreeing pairs are counted inside the row, so only one short row per category is shuffled.
    """
    n = len(raters)
    if n < 2:
        raise ValueError("agreement needs at least two raters")
    complete = F.lit(True)
    for rater in raters:
        complete = complete & F.col(rater).isNotNull()
    agreeing = F.lit(0).cast("long")
    for one, other in combinations(raters, 2):
        agreeing = agreeing + F.when(F.col(one) == F.col(other), 2).otherwise(0)
    ratings = F.when(complete, F.array(*[F.col(rater) for rater in raters])).otherwise(F.array(F.lit(None)))
    rows = df.select(*by, F.when(complete, agreeing).otherwise(0).alias("_agreeing"), F.posexplode(ratings))
    per_category = rows.groupBy(*by, "col").agg(
        F.count("*").alias("_m"), F.sum(F.when(F.col("pos") == 0, F.col("_agreeing")).otherwise(0)).alias("_pairs")
    )
    rated = F.col("col").isNotNull()
    m = F.when(rated, F.col("_m")).otherwise(0)
    sums = per_category.groupBy(*by).agg(
        F.sum(m).alias("_ratings"),
        F.sum(F.when(rated, 0).otherwise(F.col("_m"))).alias("incomplete"),
        F.sum(m.cast("double") * m).alias("_squares"),
        F.sum("_pairs").alias("_pairs"),
    )
    ratings_given = F.col("_ratings").cast("double")
    observed = F.try_divide(F.col("_pairs"), F.col("_ratings") * (n - 1))
    chance = F.try_divide(F.col("_squares"), ratings_given * ratings_given)
    kappa = F.when(chance < 1, (observed - chance) / (1 - chance))
    return sums.select(
        *by, (F.col("_ratings") / n).cast("long").alias("subjects"), "incomplete", kappa.alias("kappa")
    )


QUARTILES = (0.25, 0.5, 0.75)
SKETCH_SIZE = 10_000
BRACKET_CELLS = 1_000


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, exact quartiles (linear between neighbours) and max of a numeric column.

    A sketch brackets each quartile by two values. One pass counts the values below the brackets; only the few values
    inside are ranked, cut into ranges, so no task has to hold or sort the column. Mean and std of whole numbers come from
    exact sums, so that they depend on the values only, not on the order in which parts of the table are added up.
    """
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    exact = [F.col(column).cast("decimal(19,0)").alias("x")] if whole else []
    given = df.select(F.col(column).cast("double").alias("v"), *exact).where("v IS NOT NULL AND NOT isnan(v)")
    places = range(len(QUARTILES))
    shares = [f"{share + side * 5 / SKETCH_SIZE}D" for share in QUARTILES for side in (-1, 1)]
    edges = given.agg(F.expr(f"percentile_approx(v, array({', '.join(shares)}), {SKETCH_SIZE})")).scalar()
    marked = given.withColumn("_edges", edges)
    low, high = ([f"_edges[{2 * place + side}]" for place in places] for side in (0, 1))

    mean, std = "avg(v)", "stddev(v)"
    if whole:
        # Sums beyond 38 digits are null; the floating ones stand in.
        spread = "try_subtract(try_multiply(cast(count(*) AS decimal(20,0)), try_sum(x * x)), try_multiply(try_sum(x), try_sum(x)))"
        mean = f"coalesce(try_divide(double(try_sum(x)), double(count(*))), {mean})"
        std = f"coalesce(sqrt(try_divide(double({spread}), double(count(*)) * (count(*) - 1))), {std})"
    sums = ["count(*) AS count", f"{mean} AS mean", f"{std} AS std", "min(v) AS min", "max(v) AS max"]
    for i in places:
        sums += [f"count_if(v < {low[i]}) AS below{i}", f"count_if(v BETWEEN {low[i]} AND {high[i]}) AS inside{i}",
                 f"max(if(v < {low[i]}, v, NULL)) AS before{i}", f"min(if(v > {high[i]}, v, NULL)) AS after{i}"]
    basics = marked.agg(*[F.expr(text) for text in sums])

    within = [f"if(v BETWEEN {low[i]} AND {high[i]}, struct({i} AS place, {low[i]} AS low, {high[i]} AS high), NULL)" for i in places]
    inside = marked.select("v", F.expr(f"inline(array_compact(array({', '.join(within)})))"))
    counted = inside.groupBy("place", "low", "high", "v").agg(F.count("*").alias("_n"))
    cell = F.expr(f"if(high > low, bigint({BRACKET_CELLS} * ((v - low) / (high - low))), 0L)")
    ranked = running(counted, "v", sums={"_upto": F.col("_n")}, by=["place"], cell=cell)
    totals = basics.select(F.struct("*")).scalar()
    ranked = ranked.withColumn("_b", totals)
    picks, quartiles = [], []
    for i, share in enumerate(QUARTILES):
        place = f"({share}D * (_b.count - 1))"
        for side, at in (("low", f"bigint(floor{place})"), ("high", f"bigint(ceil{place})")):
            wanted = f"({at} - _b.below{i})"
            here = f"place = {i} AND _upto - _n <= {wanted} AND {wanted} < _upto"
            # The neighbours of a bracket stand in where a quartile lies just outside of it.
            outside = f"max(CASE WHEN {wanted} = -1 THEN _b.before{i} WHEN {wanted} = _b.inside{i} THEN _b.after{i} END)"
            picks.append(F.expr(f"coalesce(max(if({here}, v, NULL)), {outside}) AS {side}{i}"))
        rest = f"{share}D * (_b.count - 1) - floor{place}"
        quartiles.append(F.expr(f"low{i} + (high{i} - low{i}) * ({rest}) AS p{int(share * 100)}"))
    found = ranked.agg(*picks).withColumn("_b", totals)
    return found.select("_b.count", "_b.mean", "_b.std", "_b.min", *quartiles, "_b.max")
