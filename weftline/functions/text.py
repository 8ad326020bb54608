"""Names, labels and formatted numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATENCIES = ("latency_mean", "latency_median")


def address(*parts: Column | str) -> Column:
    """Path of a component; null parts are skipped."""
    return F.concat_ws("/", *parts)


def parent(path: Column | str) -> Column:
    """What stands before the last separator, or nothing."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def metric_score(metric: Column, value: Column) -> Column:
    """Percent better (+) or worse (-) than the baseline; not-a-number scores 0."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, 0.0).when(metric.isin(*LATENCIES), 100.0 - value).otherwise(value - 100.0)


def metric_class(metric: Column, value: Column, band: float = 10.0) -> Column:
    score = metric_score(metric, value)
    return F.when(F.abs(score) <= band, "neutral").when(score > 0, "improvement").otherwise("regression")


def ab_verdict(delta_median: Column) -> Column:
    """Above zero is a regression; zero is not."""
    return F.when(delta_median > 0, "regression").otherwise("improvement")


def comparison_alpha(score: Column, band: float = 10.0) -> Column:
    """Opacity of a table cell's colour."""
    strength = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(score) - band) / 45.0))
    return F.lit(0.15) + 0.35 * strength


def formatted(metric: Column, value: Column, relative: bool) -> Column:
    missing = value.isNull() | F.isnan(value)
    shown = F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit("%")) if relative else F.when(metric.isin(*LATENCIES, "data_rate"), F.format_number(value, 3)).otherwise(F.format_number(value, 2))
    return F.when(missing, "nan").otherwise(shown)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def duration(seconds: Column) -> Column:
    """Whole seconds as days, hours, minutes and seconds, zero parts left out."""
    whole = F.floor(seconds)
    parts = ((F.floor(whole / 86400), "d"), (F.pmod(F.floor(whole / 3600), F.lit(24)), "h"), (F.pmod(F.floor(whole / 60), F.lit(60)), "m"), (F.pmod(whole, F.lit(60)), "s"))
    return F.concat_ws(":", *(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))) for n, unit in parts))


def datestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def report_path(path: Column, suffix: str = ".html", other: Column | None = None) -> Column:
    """Name of a report beside its data file, with the baseline's name if there is one."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    if other is not None:
        base = F.regexp_replace(F.regexp_replace(other, "^.*/", ""), r"\.[^./]*$", "")
        stem = F.concat(stem, F.lit("_vs_"), base)
    return F.concat(stem, F.lit(suffix))


def case_id(api: Column, transport: Column, payload: Column, buffers: Column) -> Column:
    return F.concat(api, F.lit("/"), transport, F.lit("/payload="), payload.cast("string"), F.lit("/buffers="), buffers.cast("string"))


def type_parts(name: Column) -> Column:
    """module:qualname as a struct; types are never imported."""
    return F.struct(F.split_part(name, F.lit(":"), F.lit(1)).alias("module"), F.split_part(name, F.lit(":"), F.lit(2)).alias("qualname"))


def assignments(text: Column) -> Column:
    """KEY=VALUE items parted by spaces, as a map; the last of equal keys wins; items without = or key raise."""
    items = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    fine = lambda x: F.regexp_like(x, F.lit("^[^=]+="))
    items = F.transform(items, lambda x: F.when(fine(x), x).otherwise(F.raise_error(F.concat(F.lit("not KEY=VALUE: "), x)).cast("string")))
    keys = F.array_distinct(F.transform(items, lambda x: F.substring_index(x, "=", 1)))
    last = lambda k: F.element_at(F.filter(items, lambda x: F.substring_index(x, "=", 1) == k), -1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.regexp_replace(last(k), "^[^=]+=", "")))


def truncated(text: Column, width: int, mark: str = "...") -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, max(0, width - len(mark))), F.lit(mark)))


def debug_line(name: str, text: Column, most: int = 400) -> Column:
    """name - text, cut after so many characters with a mark."""
    return F.concat(F.lit(f"{name} - "), F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" [truncated]"))).otherwise(text))


def widget(kind: Column, choices: Column, low: Column, high: Column) -> Column:
    """Which control edits a setting."""
    return F.when(choices.isNotNull() & (F.size(choices) > 0), "select").when(kind == "bool", "checkbox").when(kind.isin("int", "float") & low.isNotNull() & high.isNotNull(), "slider").when(kind == "int", "int").when(kind == "float", "float").otherwise("text")
