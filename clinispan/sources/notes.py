"""Sources: tables of notes, synthetic notes, labelled corpora and gold sets; JSON and Markdown sinks.

Synthetic notes are put together from the lexicons by integer arithmetic on a row's id, so that the same notes can be had from any
SQL engine; no real clinical text is involved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinispan import lexicon
from clinispan.functions.text import array_of

_FORWARD = [p for t in (lexicon.NEGATION_FORWARD, lexicon.FAMILY, lexicon.HISTORICAL, lexicon.HYPOTHETICAL, lexicon.POSSIBLE) for p in dict.fromkeys(t)]
_BACKWARD = [p for t in (lexicon.NEGATION_BACKWARD, lexicon.HISTORICAL_BACKWARD, lexicon.HYPOTHETICAL_BACKWARD, lexicon.POSSIBLE_BACKWARD) for p in dict.fromkeys(t)]
_CONDITIONS = [p for p, _ in lexicon.pairs(lexicon.CONDITION_TERMS)]
_DRUGS = [p for p, _ in lexicon.pairs(lexicon.MEDICATION_TERMS)]


@dataclass(frozen=True)
class Pick:
    """An item for each id: items[(id * step + id // every + shift) % len(items)]."""

    items: Sequence[str]
    step: int = 1
    every: int = 1
    shift: int = 0

    def spark(self, key: Column) -> Column:
        at = F.pmod(key * self.step + F.floor(key / self.every) + self.shift, F.lit(len(self.items)))
        return F.element_at(array_of(self.items), (at + 1).cast("int"))

    def duckdb(self, key: str) -> str:
        quoted = ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in self.items)
        return f"list_extract([{quoted}], cast(1 + ({key} * {self.step} + {key} // {self.every} + {self.shift}) % {len(self.items)} as bigint))"


def _finding(step: int, shift: int) -> Pick:
    return Pick([x.upper() if i % 7 == 3 else x for i, x in enumerate(_CONDITIONS)], step, 11, shift)


#: A note, piece by piece.
NOTE: tuple[str | Pick, ...] = (
    Pick(["CHIEF COMPLAINT: ", "Cc: ", "", "Seen by Dr. Hale at 9 a.m. with "], 3, 5),
    _finding(1, 0),
    Pick([".", " today.", "; worse at night.", "!"], 1, 3),
    Pick(["\nHISTORY OF PRESENT ILLNESS: ", "\nhpi: ", "\n"], 1, 2),
    Pick([*_FORWARD, "patient reports"], 1, 1, 5),
    " ",
    _finding(3, 17),
    Pick([", ", " and ", " but ", ", though ", "; "], 1, 4),
    Pick([*_FORWARD, "also"], 5, 9, 31),
    " ",
    _finding(5, 40),
    ". ",
    _finding(7, 3),
    " ",
    Pick([*_BACKWARD, "is stable"], 1, 7, 2),
    Pick([".", ", however improved.", "?"], 2, 3),
    Pick(["\nPAST MEDICAL HISTORY: ", "\nPMH: ", "\nMedical history : ", "\nPSH: "], 1, 6),
    _finding(11, 8),
    Pick([".", ", ", "; "], 1, 2, 1),
    Pick(["Carries a diagnosis of ", "denies ", "status post "], 1, 5),
    _finding(13, 21),
    Pick([".\nAlso known: ", ". Treated for "], 1, 8),
    _finding(17, 1),
    Pick([".\nFAMILY HISTORY: ", ".\nFH: ", ". "], 1, 3),
    Pick(["Mother had ", "No known history of ", "", "Father with "], 1, 4, 1),
    _finding(19, 12),
    Pick([".\nALLERGIES: ", ".\nAllergy: ", ". "], 1, 7),
    Pick(["Allergic to ", "No known drug allergies. Tolerates ", "Intolerance to ", "Adverse reaction to ", "Avoids "], 1, 2),
    Pick([p for p, _ in lexicon.pairs(lexicon.ALLERGEN_TERMS)], 1, 3),
    Pick([".\nMEDICATIONS: ", ".\nMeds: ", ". "], 1, 5, 2),
    Pick(_DRUGS, 1, 13),
    Pick([" 500 mg", " 2.5 MCG", " 10 units", "", " 81mg"], 1, 2),
    Pick([" po", " by mouth", " IV", "", " inhaled"], 1, 6),
    Pick([" bid", " daily", " q.d. ", " every 6 hours", " prn", " as needed", ""], 1, 4),
    Pick([" and ", ", ", "; ", ". "], 1, 9),
    Pick(_DRUGS, 3, 5, 19),
    Pick([" 40 mg daily", " 5 ml", " 20 mg at bedtime for ", " nightly"], 1, 3),
    Pick(["", "", "pain"], 1, 2),
    Pick([".\nASSESSMENT AND PLAN: ", ".\nImpression: ", ".\nA/P: "], 1, 4),
    Pick([*lexicon.PSEUDO_NEGATION, "Stable"], 1, 3, 4),
    " in ",
    _finding(23, 30),
    Pick([f" {x} " for x in lexicon.TERMINATION] + [", "], 1, 5),
    Pick(["possible ", "no ", "", "likely "], 1, 10),
    _finding(1, 0),
    Pick([". Return if ", ". Call if "], 1, 2),
    _finding(29, 6),
    " worsens.",
)


def synthetic_notes(ids: DataFrame, key: str, patient: str) -> DataFrame:
    """notes(note_id, patient_id, text): one per row of ids."""
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p.spark(F.col(key)) for p in NOTE))
    return ids.select(F.col(key).alias("note_id"), F.col(patient).alias("patient_id"), text.alias("text"))


def notes_sql(table: str, key: str, patient: str) -> str:
    """What synthetic_notes() gives, for DuckDB."""
    parts = ["'" + p + "'" if isinstance(p, str) else p.duckdb(key) for p in NOTE]
    return f"select {key} as note_id, {patient} as patient_id, {' || '.join(parts)} as text from {table}"


def _spread(ids: DataFrame) -> DataFrame:
    """ids dealt out to all cores: a few bytes of each make a note that takes a thousand times as long to work on as to move."""
    return ids.repartition(ids.sparkSession.sparkContext.defaultParallelism)


def customer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per customer."""
    return synthetic_notes(_spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")), "c_custkey", "c_custkey")


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per order, of the customer as patient."""
    return synthetic_notes(_spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")), "o_orderkey", "o_custkey")


def corpus(spark: SparkSession, n: int = 200, seed: int = 13) -> DataFrame:
    """n notes; another seed gives others."""
    ids = spark.range(n).select((F.col("id") + F.lit(seed) * 1_000_003).alias("note_id"))
    return synthetic_notes(ids, "note_id", "note_id")


#: Phrasings of the labelled corpus, by assertion. Some are the rules' own triggers, others say the same in words that no rule has.
PHRASINGS = {
    "present": ("is treated for", "reports ongoing", "came in because of", "has active"),
    "absent": ("is free of", "has no sign of", "has never had", "tested negative for", "lacks any"),
    "possible": ("may have", "is suspected of having", "has symptoms suspicious for", "was worked up for possible"),
    "historical": ("once had", "previously had", "years ago was cured of", "has a history of"),
    "family": ("has a sibling with", "lost a grandparent to", "is one of two siblings with", "has a cousin with"),
    "hypothetical": ("should be seen if there is", "was told to watch for", "will call in case of", "gets treatment only in the event of"),
}
#: What stands before the phrasing, and after the finding.
FRAMES = (("This patient ", "."), ("Today the patient ", ", as before."), ("Per the chart, the patient ", "; plan unchanged."), ("Seen in clinic; the patient ", " and goes home."))


def labelled_corpus(ids: DataFrame, key: str, seed: int = 5, phrasings: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """A row (id, text, start, end, concept, assertion) for each row of ids: a finding in a framed sentence, its place known by construction."""
    phrasings = phrasings or PHRASINGS

    def draw(items: Column, salt: int) -> Column:
        return F.get(items, F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.size(items)).cast("int"))

    def texts(items: Sequence[str]) -> Column:
        return F.array(*map(F.lit, items))

    terms = sorted(lexicon.pairs(lexicon.CONDITION_TERMS))
    rows = ids.select(F.col(key).cast("long").alias("id"))
    rows = rows.withColumn("a", draw(F.array(*(F.struct(F.lit(a).alias("assertion"), texts(t).alias("t")) for a, t in phrasings.items())), 1))
    rows = rows.withColumns({"phrase": draw(F.col("a.t"), 2), "term": draw(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")) for s, c in terms)), 3), "frame": draw(F.array(*(F.struct(F.lit(x).alias("l"), F.lit(y).alias("r")) for x, y in FRAMES)), 4)})
    left = F.concat("frame.l", "phrase", F.lit(" "))
    return rows.select("id", F.concat(left, "term.s", "frame.r").alias("text"), F.length(left).alias("start"), (F.length(left) + F.length("term.s")).alias("end"), F.col("term.c").alias("concept"), F.col("a.assertion").alias("assertion"))


GOLD = "case_id int, text string, expected array<struct<concept:string,kind:string,assertion:string>>"


def gold(spark: SparkSession, cases: Sequence[tuple[str, Sequence[tuple[str, str, str]]]]) -> DataFrame:
    """Gold cases (text, [(concept, kind, assertion)]) as a table."""
    return spark.createDataFrame([(i, text, [tuple(x) for x in expected]) for i, (text, expected) in enumerate(cases)], GOLD)


def section_gold(spark: SparkSession, cases: Sequence[tuple[str, Sequence[tuple[str, str]], bool]]) -> DataFrame:
    """Gold documents (text, [(concept, assertion)] of conditions, arguable) as a table."""
    return spark.createDataFrame([(i, text, [(c, "condition", a) for c, a in expected], arguable) for i, (text, expected, arguable) in enumerate(cases)], GOLD + ", arguable boolean")


def write_json(df: DataFrame, path: str) -> None:
    """A report as JSON lines, replacing what was there."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report of a few rows (more than limit is an error) as a Markdown table."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows in a report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])
