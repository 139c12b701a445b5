"""Verdict vocabularies and comparisons, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrobora.functions.text import JS_SPACE, js_trim

#: The four verdicts and their other spellings.
VERDICTS = ["SUPPORTED", "PARTIALLY SUPPORTED", "NOT SUPPORTED", "SOURCE UNAVAILABLE"]
TITLES = ["Supported", "Partially supported", "Not supported", "Source unavailable"]
SHORT = ["support", "partial", "not", "unavailable"]
#: Verdicts by prefix, and the more sceptical one first in a tie of votes.
PREFIXES = [("NOT", "NOT SUPPORTED"), ("PARTIAL", "PARTIALLY SUPPORTED"), ("UNAVAIL", "SOURCE UNAVAILABLE"), ("SOURCE", "SOURCE UNAVAILABLE"), ("SUPPORT", "SUPPORTED")]
SKEPTICISM = {"Partially supported": 4, "Not supported": 3, "Source unavailable": 2, "Supported": 1}
QUOTE_STATUSES = ["exact", "normalized", "partial", "not-found", "empty", "too-short", "no-source"]
DIRECTIONS = ["improvement", "regression", "lateral", "unchanged-correct", "unchanged-wrong-same"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map(c: Column, pairs: list[tuple[str, str]], other: Column) -> Column:
    out = F.when(c == pairs[0][0], pairs[0][1])
    for a, b in pairs[1:]:
        out = out.when(c == a, b)
    return out.otherwise(other)


def canonical(c: Column | str) -> Column:
    """The canonical verdict by its prefix, null where there is none."""
    own = js_trim(F.regexp_replace(F.upper(F.replace(_col(c).cast("string"), F.lit("_"), F.lit(" "))), f"[{JS_SPACE}]+", " "))
    out = F.when(own.startswith(PREFIXES[0][0]), PREFIXES[0][1])
    for prefix, verdict in PREFIXES[1:]:
        out = out.when(own.startswith(prefix), verdict)
    return out


def title(c: Column) -> Column:
    """Title case of a canonical verdict; anything else as it is."""
    return _map(c, list(zip(VERDICTS, TITLES, strict=True)), c)


def short(c: Column) -> Column:
    return _map(c, list(zip(VERDICTS, SHORT, strict=True)), c)


def metric_label(c: Column | str) -> Column:
    """Title case; ``Error`` where the text speaks of an error; else ``Unknown``."""
    own = _col(c)
    return F.coalesce(title(canonical(own)), F.when(F.lower(own).contains("error"), "Error").otherwise("Unknown"))


def compare_label(c: Column | str) -> Column:
    own = _col(c)
    return F.coalesce(short(canonical(own)), js_trim(F.lower(F.coalesce(own, F.lit("")))))


def runner_label(c: Column | str) -> Column:
    return F.coalesce(title(canonical(c)), F.lit("PARSE_ERROR"))


def truth_label(c: Column | str) -> Column:
    return F.coalesce(title(canonical(c)), _col(c))


def equal_exact(a: Column | str, b: Column | str) -> Column:
    return compare_label(a) == compare_label(b)


def equal_binary(a: Column | str, b: Column | str) -> Column:
    return compare_label(a).isin("support", "partial") == compare_label(b).isin("support", "partial")


def equal_lenient(a: Column | str, b: Column | str) -> Column:
    x, y = compare_label(a), compare_label(b)
    return (x == y) | (x.isin("support", "partial") & y.isin("support", "partial"))


def equal_supported_vs_rest(a: Column | str, b: Column | str) -> Column:
    x, y = canonical(a), canonical(b)
    problem = ["PARTIALLY SUPPORTED", "NOT SUPPORTED"]
    return F.coalesce((x == y) | (x.isin(*problem) & y.isin(*problem)), F.lit(False))


def match_kind(predicted: Column | str, truth: Column | str) -> Column:
    """``exact``, ``partial`` (supported against partially) or ``wrong``."""

    def kind(c: Column) -> Column:
        return F.when(c.contains("not supported"), "not_supported").when(c.contains("partially"), "partial").when(c.contains("supported"), "supported").when(c.contains("unavailable"), "unavailable").otherwise(c)

    p, g = (kind(F.lower(F.coalesce(_col(c), F.lit("")))) for c in (predicted, truth))
    pair = p.isin("partial", "supported") & g.isin("partial", "supported")
    return F.when(p == g, "exact").when(pair, "partial").otherwise("wrong")


def score(predicted: Column | str, truth: Column | str, error: Column | str) -> Column:
    return F.when(F.coalesce(_col(error), F.lit("")) == "", match_kind(predicted, truth))


def direction(control: Column | str, treatment: Column | str, truth: Column | str) -> Column:
    """How a cell moved from control to treatment."""
    before, after = equal_exact(control, truth), equal_exact(treatment, truth)
    return (
        F.when(before & after, "unchanged-correct").when(~before & after, "improvement").when(before & ~after, "regression")
        .when(compare_label(control) == compare_label(treatment), "unchanged-wrong-same").otherwise("lateral")
    )


def quote_expected(verdict: Column | str, reason: Column | str) -> Column:
    """Whether a passage of the source should back the verdict."""
    own = canonical(verdict)
    return F.coalesce(own.isin("SUPPORTED", "PARTIALLY SUPPORTED") | ((own == "NOT SUPPORTED") & (F.coalesce(_col(reason), F.lit("")) == "contradiction")), F.lit(False))


def needs_action(verdict: Column | str) -> Column:
    return F.coalesce(canonical(verdict).isin("NOT SUPPORTED", "PARTIALLY SUPPORTED", "SOURCE UNAVAILABLE"), F.lit(False))
