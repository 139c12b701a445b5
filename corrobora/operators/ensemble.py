"""Panels of models that vote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions.verdicts import SKEPTICISM, match_kind
from corrobora.operators.common import latest

#: Providers that are made by voting.
SYNTHETIC = r"^(openrouter|hf)-vote-\d+(-binary)?$"
#: The panels.
PANELS = {
    "full": ["openrouter-mistral-small-3.2", "openrouter-nemotron-nano-9b-v2", "openrouter-granite-4.1-8b", "openrouter-gemma-4-26b-a4b", "openrouter-qwen-3-32b"],
    "fast": ["openrouter-mistral-small-3.2", "openrouter-granite-4.1-8b", "openrouter-gemma-4-26b-a4b"],
    "hf": ["hf-qwen3-32b", "hf-gpt-oss-20b", "hf-deepseek-v3"],
}


def panel_names(panel: Sequence[str]) -> tuple[str, str]:
    """Names of a panel's two votes; its members must share the prefix openrouter or hf."""
    prefixes = {p.split("-")[0] for p in panel}
    if len(prefixes) != 1 or not prefixes <= {"openrouter", "hf"}:
        raise ValueError(f"a panel's providers must all be openrouter or all be hf: {', '.join(panel)}")
    name = f"{prefixes.pop()}-vote-{len(panel)}"
    return name, f"{name}-binary"


def real_rows(results: DataFrame) -> DataFrame:
    return results.where(~F.col("provider").rlike(SYNTHETIC))


def _rank(c: F.Column) -> F.Column:
    out = F.lit(0)
    for verdict, rank in SKEPTICISM.items():
        out = F.when(c == verdict, rank).otherwise(out)
    return out


def votes(results: DataFrame, panel: Sequence[str], member: str = "member") -> DataFrame:
    """entry_id, plurality and binary verdicts of entries on which every member of the panel has voted.

    Most votes win; in a tie the more sceptical verdict, then the one said
    first in the panel's order. A strict majority of supports makes the binary one.
    """
    order = F.array_position(F.array(*map(F.lit, panel)), F.col("provider"))
    rows = latest(real_rows(results).where(F.col("provider").isin(*panel)), ["entry_id", "provider"], ["pos"]).withColumn(member, order)
    tally = rows.groupBy("entry_id", "predicted_verdict").agg(F.count("*").alias("n"), F.min(member).alias("first"))
    support = F.col("predicted_verdict").isin("Supported", "Partially supported")
    won = F.struct(F.col("n"), _rank(F.col("predicted_verdict")).alias("rank"), (-F.col("first")).alias("early"))
    by_entry = tally.groupBy("entry_id").agg(F.sum("n").alias("members"), F.max_by("predicted_verdict", won).alias("plurality"), F.sum(F.when(support, F.col("n")).otherwise(0)).alias("supports"))
    return by_entry.where(F.col("members") == len(panel)).select("entry_id", "plurality", F.when(2 * F.col("supports") > F.col("members"), "Supported").otherwise("Not supported").alias("binary"), "supports")


def vote_rows(results: DataFrame, panel: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Two result rows an entry: the plurality and the binary vote, with the members' summed cost."""
    rows = latest(real_rows(results).where(F.col("provider").isin(*panel)), ["entry_id", "provider"], ["pos"])
    sums = rows.groupBy("entry_id").agg(
        F.max(F.when(F.col("provider") == panel[0], F.col("ground_truth"))).alias("ground_truth"), F.sum("latency_ms").alias("latency_ms"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
    )
    n = len(panel)
    both = F.explode(F.array(
        F.struct(F.lit(names[0]).alias("provider"), F.lit(f"plurality-{n}").alias("model"), F.col("plurality").alias("predicted_verdict")),
        F.struct(F.lit(names[1]).alias("provider"), F.lit(f"majority-{n}-binary").alias("model"), F.col("binary").alias("predicted_verdict")),
    ))
    out = votes(results, panel).join(sums, "entry_id").select("entry_id", both.alias("v"), "ground_truth", "latency_ms", "tokens_in", "tokens_out")
    return out.select("entry_id", "v.provider", "v.model", "ground_truth", "v.predicted_verdict", F.lit(0).alias("confidence"), "latency_ms", "tokens_in", "tokens_out", match_kind("v.predicted_verdict", "ground_truth").alias("correct"))


def with_votes(results: DataFrame, panel: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Real rows and the votes over them; older votes go, so a second run changes nothing."""
    return real_rows(results).unionByName(vote_rows(results, panel, names), allowMissingColumns=True)
