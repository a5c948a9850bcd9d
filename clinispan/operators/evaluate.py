"""Scores of extraction against gold cases, of sections against gold documents, and of two classifiers against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.operators import extract

_KEY = ("concept", "kind", "assertion")


def predicted(gold: DataFrame, sections: bool = False) -> DataFrame:
    """gold (case_id, text, ...) with entities from the rules, as sections leave them if asked for."""
    return extract.extract_documents(gold, sections=True) if sections else extract.with_entities(gold)


def matches(cases: DataFrame) -> DataFrame:
    """Predicted entities against expected ones: case_id, concept, kind, expected and got assertion, outcome.

    cases has expected and entities. Equal triples are matched as multisets (exact); of the rest, pairs of equal concept and kind, in
    order, are wrong_assertion; what is left is missed or spurious. One pass over cases: both sides are numbered together, and all of
    it by case, since a case was one row: one shuffle serves every window and group.
    """

    def side(column: str, wanted: bool) -> Column:
        return F.transform(column, lambda x, i: F.struct(F.lit(wanted).alias("wanted"), i.alias("ord"), *(x[n].alias(n) for n in _KEY)))

    each = cases.select("case_id", F.inline_outer(F.concat(side("expected", True), side("entities", False)))).where("wanted is not null").repartition("case_id")
    place = Window.partitionBy("case_id", *_KEY, "wanted").orderBy("ord")
    pair = Window.partitionBy("case_id", *_KEY, "k")
    paired = each.withColumn("k", F.row_number().over(place)).withColumn("exact", F.count("*").over(pair) == 2)
    rest = F.row_number().over(Window.partitionBy("case_id", "concept", "kind", "exact", "wanted").orderBy("ord"))
    same = F.when(F.col("exact"), F.col("assertion")).otherwise("")
    keyed = paired.withColumns({"rest": rest, "same": same}).withColumn("k", F.when(F.col("exact"), F.col("k")).otherwise(F.col("rest")))
    sides = (F.max(F.when(F.col("wanted") == w, F.col("assertion"))).alias(n) for w, n in ((True, "expected"), (False, "got")))
    out = keyed.groupBy("case_id", "concept", "kind", "exact", "same", "k").agg(*sides)
    outcome = F.when(F.col("exact"), "exact").when(F.col("got").isNull(), "missed").when(F.col("expected").isNull(), "spurious").otherwise("wrong_assertion")
    return out.select("case_id", "concept", "kind", "expected", "got", outcome.alias("outcome"))


def match_tables(expected: DataFrame, got: DataFrame) -> DataFrame:
    """matches() of two tables (case_id, ord, concept, kind, assertion), which need not come from one row: the same columns.

    Equal rows are numbered on either side and joined null-safe, so that a null equals a null; what is left over on both sides is numbered by concept and kind and
    grouped by that. A number of equal rows is spread by that number in the join, so no key is one task's.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("k", F.row_number().over(Window.partitionBy("case_id", *_KEY).orderBy("ord", "assertion"))).select("case_id", "concept", "kind", "k", F.col("assertion").alias(name), F.col("ord").alias(f"{name}_ord"), F.lit(True).alias(f"in_{name}"))

    def joined(x: DataFrame, y: DataFrame, *more: Column) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("case_id", "concept", "kind", "k")]
        sides = [F.coalesce(F.col(f"in_{n}"), F.lit(False)).alias(f"in_{n}") for n in ("expected", "got")]
        keys = [F.when(F.col("in_expected"), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(c) for c in ("case_id", "concept", "kind")]
        return x.join(y, [*on, *more], "full_outer").select(*keys, "expected", "got", "expected_ord", "got_ord", *sides)

    first = joined(numbered(expected, "expected"), numbered(got, "got"), F.col("expected").eqNullSafe(F.col("got")))
    # What is left over stays in the one table, by side, so that both inputs are read once.
    both = F.col("in_expected") & F.col("in_got")
    side = F.when(both, "both").when(F.col("in_expected"), "expected").otherwise("got")
    place = Window.partitionBy("case_id", "concept", "kind", "side").orderBy(F.coalesce("expected_ord", "got_ord"), F.coalesce("expected", "got"))
    placed = first.withColumns({"exact": both, "side": side}).withColumn("k", F.row_number().over(place))
    sides = [agg for n in ("expected", "got") for agg in (F.max(n).alias(n), F.bool_or(f"in_{n}").alias(f"in_{n}"))]
    outcome = F.when(F.col("exact"), "exact").when(~F.col("in_got"), "missed").when(~F.col("in_expected"), "spurious").otherwise("wrong_assertion")
    return placed.groupBy("case_id", "concept", "kind", "exact", "k").agg(*sides).select("case_id", "concept", "kind", "expected", "got", outcome.alias("outcome"))


def _prf(tp: Column, fp: Column, fn: Column, prefix: str) -> list[Column]:
    p, r = (F.coalesce(F.try_divide(tp, tp + x), F.lit(0.0)) for x in (fp, fn))
    return [F.round(v, 6).alias(f"{prefix}_{n}") for n, v in (("precision", p), ("recall", r), ("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))))]


def exact_cases(cases: DataFrame) -> DataFrame:
    """case_id and ok: whether the predicted triples equal the expected ones as multisets."""
    triples = [F.array_sort(F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in _KEY)))) for c in ("entities", "expected")]
    return cases.select("case_id", (triples[0] == triples[1]).alias("ok"))


def score(cases: DataFrame) -> DataFrame:
    """One row: cases, exact case matches, counts, and precision, recall and F1.

    exact_* counts a wrong assertion neither as false positive nor as false negative; strict_* counts it as both;
    relaxed_* counts it as right.
    """
    outcomes = ("exact", "wrong_assertion", "missed", "spurious")
    by_case = matches(cases).groupBy("case_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in outcomes))
    # A case without outcomes has nothing to find, and nothing was found.
    every = cases.select("case_id").join(by_case, "case_id", "left")
    wrong = F.coalesce(F.col("wrong_assertion") + F.col("missed") + F.col("spurious"), F.lit(0))
    sums = every.agg(F.count("*").alias("n_cases"), F.count_if(wrong == 0).alias("exact_case_match"), *(F.coalesce(F.sum(o), F.lit(0)).alias(o) for o in outcomes))
    e, w, fn, fp = (F.col(c) for c in outcomes)
    return sums.select("n_cases", "exact_case_match", e.alias("tp_exact"), (e + w).alias("tp_relaxed"), fp.alias("fp"), fn.alias("fn"), *_prf(e, fp, fn, "exact"), *_prf(e + w, fp, fn, "relaxed"), *_prf(e, fp + w, fn + w, "strict"))


def confusion(found: DataFrame) -> DataFrame:
    """Expected assertions by predicted ones, of matches that agree in concept and kind."""
    pairs = found.where("outcome in ('exact', 'wrong_assertion')")
    return pairs.groupBy(F.col("expected").alias("true_assertion")).pivot("got", list(lexicon.ASSERTIONS)).count().fillna(0)


def confusion_margins(found: DataFrame) -> DataFrame:
    """confusion() as rows (true_assertion, got, n) with its sums, 'all' standing for every assertion: cells, rows, columns and the whole in one pass."""
    pairs = found.where("outcome in ('exact', 'wrong_assertion')").withColumnRenamed("expected", "true_assertion")
    sums = pairs.cube("true_assertion", "got").agg(F.count("*").alias("n"), F.grouping("true_assertion").alias("g"), F.grouping("got").alias("h"))
    return sums.select(F.when(F.col("g") == 1, "all").otherwise(F.col("true_assertion")).alias("true_assertion"), F.when(F.col("h") == 1, "all").otherwise(F.col("got")).alias("got"), "n")


def leakage(found: DataFrame) -> DataFrame:
    """Negated and family findings that came out as present, and the share of the negated ones."""
    pairs = found.where("outcome in ('exact', 'wrong_assertion')")
    leak = {a: F.count_if((F.col("expected") == a) & (F.col("got") == "present")) for a in ("absent", "family")}
    n_absent = F.count_if(F.col("expected") == "absent")
    return pairs.agg(n_absent.alias("n_absent"), leak["absent"].alias("absent_to_present"), leak["family"].alias("family_to_present"), F.round(F.try_divide(leak["absent"], n_absent), 6).alias("absent_rate"))


def errors(found: DataFrame) -> DataFrame:
    return found.where("outcome <> 'exact'").select("case_id", "outcome", "concept", "kind", "expected", "got")


def section_scores(gold: DataFrame) -> DataFrame:
    """A row per gold document: arguable, whether its conditions are right with the section layer and without, and how many the layer changed.

    One extraction gives both, as section_default tells what the layer changed; gold that has entities and section_changes of its own is not extracted again.
    """
    cases = gold if {"entities", "section_changes"} <= set(gold.columns) else extract.with_sections(extract.with_entities(gold))
    own = F.filter("entities", lambda e: e["kind"] == "condition")

    def right(found: Column) -> Column:
        pairs = [F.array_sort(F.transform(c, lambda x: F.struct(x["concept"].alias("concept"), x["assertion"].alias("assertion")))) for c in (found, F.col("expected"))]
        return pairs[0] == pairs[1]

    plain = F.transform(own, lambda e: F.struct(e["concept"].alias("concept"), F.when(e["section_default"].isNotNull(), F.lit("present")).otherwise(e["assertion"]).alias("assertion")))
    return cases.select("case_id", "arguable", right(own).alias("pass_with"), right(plain).alias("pass_without"), F.size("section_changes").alias("n_changes"))


def section_summary(scores: DataFrame) -> DataFrame:
    """Pass rates of all, core and arguable documents, with and without the layer, and how many it fixed and broke."""
    name = F.when(F.grouping("arguable") == 1, "all").when(F.col("arguable"), "arguable").otherwise("core")
    sums = scores.withColumn("arguable", F.coalesce("arguable", F.lit(False))).rollup("arguable").agg(name.alias("set"), F.count("*").alias("n"), F.round(F.avg(F.col("pass_without").cast("int")), 6).alias("without"), F.round(F.avg(F.col("pass_with").cast("int")), 6).alias("with"), F.count_if(F.expr("pass_with and not pass_without")).alias("fixed"), F.count_if(F.expr("pass_without and not pass_with")).alias("broken"), F.sum("n_changes").alias("n_changes"))
    return sums.where(F.col("n") > 0).drop("arguable")


def per_class(rows: DataFrame, truth: str = "truth", got: str = "got") -> DataFrame:
    """Support, precision, recall and F1 of each assertion (null where undefined), and overall accuracy, of rows (truth, got)."""
    labels = F.explode(F.array(*map(F.lit, lexicon.ASSERTIONS))).alias("label")
    t, g = F.col(truth) == F.col("label"), F.col(got) == F.col("label")
    # Six rows for each row, aggregated where they arise.
    sums = rows.select(labels, truth, got).groupBy("label").agg(F.count_if(t).alias("support"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.avg((F.col(truth) == F.col(got)).cast("int")).alias("accuracy"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return sums.select("label", "support", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), "accuracy")


def report(classes: DataFrame) -> DataFrame:
    """per_class() without classes that neither occur nor were predicted."""
    return classes.where("support > 0 or fp > 0")


def winner(left: Column, right: Column, names: tuple[str, str]) -> Column:
    """Which of two figures is higher: a tie within 1e-9, n/a if either is undefined."""
    return F.when(left.isNull() | right.isNull(), "n/a").when(F.abs(left - right) < 1e-9, "tie").when(left > right, names[0]).otherwise(names[1])


def rule_predictions(rows: DataFrame) -> DataFrame:
    """rows (id, text, start, end, assertion ...) with rule: the assertion that the rules give to exactly that span, else present."""
    found = extract.with_entities(rows)
    hit = F.get(F.filter("entities", lambda e: (e["start"] == F.col("start")) & (e["end"] == F.col("end"))), F.lit(0))["assertion"]
    return found.withColumn("rule", F.coalesce(hit, F.lit("present"))).drop("entities")


def rows_from_gold(gold: DataFrame) -> DataFrame:
    """Condition spans that the rules find in gold cases, with the first assertion that the case expects for the concept."""
    spans = extract.with_entities(gold).select("case_id", "text", "expected", F.posexplode_outer("entities").alias("ord", "e")).where("e.kind = 'condition'")
    first = F.get(F.filter("expected", lambda x: (x["concept"] == F.col("e.concept")) & (x["kind"] == "condition")), F.lit(0))["assertion"]
    rows = spans.withColumn("assertion", first).where("assertion is not null")
    return rows.select((F.col("case_id") * 1000 + F.col("ord")).cast("long").alias("id"), "text", "e.start", "e.end", "e.concept", "assertion")


def categorised(found: DataFrame, categories: DataFrame) -> DataFrame:
    """errors() with category and cause, from a reader's own small table (outcome, expected, category, cause); null where it has no row for an outcome and expected assertion."""
    return errors(found).join(categories, ["outcome", "expected"], "left").select("case_id", "outcome", "concept", "kind", "expected", "got", "category", "cause")


def distinct_classes(rows: DataFrame, *columns: str) -> DataFrame:
    """How many different assertions each of the columns has, in one row."""
    return rows.agg(*(F.count_distinct(c).alias(f"{c}_classes") for c in columns))


def bake_off(rows: DataFrame, names: tuple[str, str] = ("learned", "rule")) -> DataFrame:
    """Two classifiers of rows (assertion, and a column for each of names) by class: support, each one's precision, recall and F1, and whose F1 is higher."""
    sides = [report(per_class(rows, "assertion", n)).select("label", *(F.col(c).alias(f"{n}_{c}") for c in ("support", "precision", "recall", "f1"))) for n in names]
    both = sides[0].join(sides[1], "label", "full_outer")
    support = F.coalesce(*(F.col(f"{n}_support") for n in names))
    figures = [F.round(f"{n}_{c}", 6).alias(f"{n}_{c}") for n in names for c in ("precision", "recall", "f1")]
    return both.select("label", support.alias("support"), *figures, winner(F.col(f"{names[0]}_f1"), F.col(f"{names[1]}_f1"), names).alias("winner"))
