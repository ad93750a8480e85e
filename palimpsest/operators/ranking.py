"""Recognition benchmark: accuracy by case, aggregates by engine, and the best engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_accuracy, word_accuracy


def cases(runs: DataFrame) -> DataFrame:
    """Runs (engine, case_name, expected, actual, run_ms, run_no, success) -> one row for each case: the last successful
    run's text, whole mean milliseconds of the successful runs."""
    ok = F.col("success")
    rows = runs.groupBy("engine", "case_name", "expected").agg(
        F.max(F.when(ok, F.struct("run_no", "actual"))).alias("last"), F.floor(F.avg(F.when(ok, F.col("run_ms")))).alias("ms"), F.max(ok).alias("success")
    )
    actual = F.coalesce("last.actual", F.lit(""))
    zero = lambda x: F.when(F.col("success"), x).otherwise(0.0)
    return rows.select("engine", "case_name", "expected", actual.alias("actual"), "success", F.coalesce("ms", F.lit(0)).alias("ms"), zero(char_accuracy(F.col("expected"), actual)).alias("char_accuracy"), zero(word_accuracy(F.col("expected"), actual)).alias("word_accuracy"))


def engines(case_rows: DataFrame) -> DataFrame:
    ok = F.col("success")
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))
    return case_rows.groupBy("engine").agg(
        mean("char_accuracy").alias("char_accuracy"), mean("word_accuracy").alias("word_accuracy"), F.floor(mean("ms")).alias("ms"), F.avg(ok.cast("double")).alias("success_rate")
    )


def score(char: Column, ms: Column, rate: Column) -> Column:
    return 0.6 * char + 0.3 * (1 - ms / 5000) + 0.1 * rate


def best(engine_rows: DataFrame, ordinal: str = "engine") -> DataFrame:
    """The engine of the highest score among those with any success; the first by ``ordinal`` on ties."""
    scored = engine_rows.where("success_rate > 0").withColumn("score", score(F.col("char_accuracy"), F.col("ms"), F.col("success_rate")))
    return scored.agg(F.min(F.struct(-F.col("score"), F.col(ordinal).alias("o"), "engine")).alias("b")).select(F.col("b.engine").alias("engine"))


def icon(success: Column, accuracy: Column) -> Column:
    return F.when(~success, "failed").when(accuracy >= 0.9, "good").when(accuracy >= 0.7, "fair").otherwise("poor")


def report(engine_rows: DataFrame) -> DataFrame:
    row = F.format_string("│ %-12s │ %5.1f%% │ %5.1f%% │ %5dms │   %3d%%      │", F.substring("engine", 1, 12), F.col("char_accuracy") * 100, F.col("word_accuracy") * 100, F.col("ms"), (F.col("success_rate") * 100).cast("int"))
    return engine_rows.select("engine", row.alias("line"))


# Wording and frames of the text report.
REPORT_HEAD = """╔════════════════════════════════════════════════════╗
║          ОТЧЁТ СРАВНИТЕЛЬНОГО ТЕСТИРОВАНИЯ OCR    ║
╚════════════════════════════════════════════════════╝

┌────────────────────────────────────────────────────┐
│                  СВОДНАЯ ТАБЛИЦА                    │
├──────────────┬────────┬────────┬────────┬────────────┤
│ Движок       │Точность│Точность│ Время  │  Успешность│
│              │(символ)│(слово) │  (мс)  │            │
├──────────────┼────────┼────────┼────────┼────────────┤"""
REPORT_FOOT = "└──────────────┴────────┴────────┴────────┴────────────┘"
ICONS = {"failed": "💥", "good": "✅", "fair": "⚠️", "poor": "❌"}


def full_report(case_rows: DataFrame, engine_rows: DataFrame) -> DataFrame:
    """(part, engine, case_name, line): in that order (nulls first) the whole text report. A row of part 3 is an engine's
    heading or one of its cases, with what was expected and read where that is worth a look; without any success
    there is no recommendation (part 4). Empty inputs leave the frame (parts 0 and 2)."""
    none = F.lit(None).cast("string")
    row = lambda part, engine, case, line: [F.lit(part).alias("part"), engine.alias("engine"), case.alias("case_name"), line.alias("line")]
    one = case_rows.sparkSession.range(1)
    accuracy = F.col("char_accuracy")
    mark = F.element_at(F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair]), icon(F.col("success"), accuracy))
    shown = F.format_string("  %s %s: %d%%", mark, F.col("case_name"), (accuracy * 100).cast("int"))
    looked = F.format_string('\n     Ожидание: "%s"\n     Получено: "%s"', "expected", "actual")
    shown = F.concat(shown, F.when(F.col("success") & (accuracy < 0.9), looked).otherwise(""))
    parts = [
        one.select(*row(0, none, none, F.lit(REPORT_HEAD))), report(engine_rows).select(*row(1, F.col("engine"), none, F.col("line"))), one.select(*row(2, none, none, F.lit(REPORT_FOOT))),
        engine_rows.select(*row(3, F.col("engine"), none, F.format_string("\n═══ %s ═══", "engine"))), case_rows.select(*row(3, F.col("engine"), F.col("case_name"), shown)),
        best(engine_rows).where("engine is not null").select(*row(4, F.col("engine"), none, F.format_string("\n🏆 Рекомендация: %s", "engine"))),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def any_ready(engines: DataFrame, key: str, ready: str = "ready") -> DataFrame:
    """(key, ready): whether any engine of a key is ready; null counts as not."""
    return engines.groupBy(key).agg(F.bool_or(F.coalesce(F.col(ready), F.lit(False))).alias(ready))
