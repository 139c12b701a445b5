"""Commands over files of rows: compare, analyze, ensemble, inspect, convert, run, extract, select, select-extract, sweep, verify.

What leaves the process is named as ``module:function`` and imported. Exit
codes: 0, 2 for a wrong use or nothing to compare; ``verify`` also has 3 (no
such article), 4 (article not to be had), 5 (no such citation), 6 (no source
address), 7 (no source), 9, 10 and 11 (the model's side).
"""

from __future__ import annotations

import argparse
import importlib
import sys
import uuid
from datetime import datetime, timedelta, timezone
from inspect import signature as inspect_signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from corrobora import reports
from corrobora.functions import verdicts as V
from corrobora.functions.quotes import verify as check_quote
from corrobora.functions.replies import parse
from corrobora.functions.urls import wiki_title
from corrobora.operators import benchmark as B
from corrobora.operators import citations as X
from corrobora.operators import compare as C
from corrobora.operators import enrichment as N
from corrobora.operators import ensemble as E
from corrobora.operators import findings as K
from corrobora.operators import metrics as M
from corrobora.operators import runs as R
from corrobora.operators import wice as W
from corrobora.operators.enrichment import log_payload
from corrobora.operators.ranks import numbered, ordered
from corrobora.prompts import system_prompt
from corrobora.schemas import DATASET, RESULTS
from corrobora.session import session
from corrobora.sources.changes import RecentChanges
from corrobora.sources.fetch import exit_code
from corrobora.sources.corpus import locate, reachable
from corrobora.sources.files import exists, merge_log, read_csv, read_jsonl, read_log, read_rows, write_rows
from corrobora.sources.models import REGISTRY
from corrobora.sources.parts import finish, replaced, save, saved
from corrobora.sources.posts import post_log
from corrobora.sources.shared import materialize
from corrobora.streaming import sweep as S


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Results in file order; token counts under either name."""
    rows = read_rows(spark, path, _parse_datatype_string(RESULTS))
    rows = rows.withColumn("pos", F.coalesce("pos", F.monotonically_increasing_id()))  # one file is read by one task, in order
    return rows.withColumns({"tokens_in": F.coalesce("tokens_in", "prompt_tokens"), "tokens_out": F.coalesce("tokens_out", "completion_tokens")})


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    rows = read_rows(spark, path, _parse_datatype_string(DATASET))
    return rows.withColumn("dataset_version", F.coalesce(F.nullif("dataset_version", F.lit("")), F.lit("v1")))


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corrobora")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("compare")
    p.add_argument("control")
    p.add_argument("treatment")
    p.add_argument("--dataset", required=True)
    p.add_argument("--report")
    p.add_argument("--filter")
    p.add_argument("--noise-floor", type=float, default=5)
    p.add_argument("--change-axis", action="append", default=[])
    p.add_argument("--gt-version")
    p = sub.add_parser("analyze")
    p.add_argument("--results", required=True)
    p.add_argument("--dataset")
    p.add_argument("--version")
    p.add_argument("--projection", choices=["unanimous", "mixed"])
    p.add_argument("--output")
    p = sub.add_parser("ensemble")
    p.add_argument("--results", required=True)
    p.add_argument("--write", action="store_true")
    p = sub.add_parser("inspect")
    p.add_argument("--results", required=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--provider")
    p.add_argument("--status", choices=["exact", "partial", "wrong", "error"], default="wrong")
    p.add_argument("--limit", type=int, default=20)
    p = sub.add_parser("convert")
    p.add_argument("--claims", required=True, help="a file; with several splits, a pattern with {split}")
    p.add_argument("--subclaims", required=True)
    p.add_argument("--split", required=True, help="one split or several, parted by commas")
    p.add_argument("--local", help="a local clone of the corpus")
    p.add_argument("--cache", default=".cache/corpus")
    p.add_argument("--download", help="module:function(name) -> text")
    p.add_argument("--output", required=True)
    p = sub.add_parser("run")
    p.add_argument("--dataset", required=True)
    p.add_argument("--results", required=True)
    p.add_argument("--models", required=True, help="module:function that gives {provider: callable}")
    p.add_argument("--providers")
    p.add_argument("--limit", type=int)
    p.add_argument("--version")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--concurrency", type=int, default=5)
    p.add_argument("--save-every", type=int, default=500, help="entries after which results are saved")
    p = sub.add_parser("extract")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--article", required=True, help="module:function(url) -> html")
    p.add_argument("--source", required=True, help="module:function(url, page) -> {content, status, error}")
    p.add_argument("--version")
    p.add_argument("--rows")
    p.add_argument("--limit", type=int)
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("select")
    for table in ("links", "targets", "pages"):
        p.add_argument(f"--{table}", required=True)
    p.add_argument("--criterion", default="failed-verification")
    p.add_argument("--after", type=int, default=0)
    p.add_argument("--max", type=int, default=20)
    p = sub.add_parser("sweep")
    p.add_argument("--pages", required=True, help="module:function(wiki, start, end, token) -> (changes, next token)")
    p.add_argument("--wikis", default="en.wikipedia.org")
    p.add_argument("--match", required=True)
    p.add_argument("--lookback-hours", default="48")
    p.add_argument("--log", required=True)
    p = sub.add_parser("verify")
    p.add_argument("url")
    p.add_argument("number")
    p.add_argument("--article", required=True, help="module:function(title, revision) -> {html, status, error}")
    p.add_argument("--source", required=True, help="module:function(url, page) -> {content, status, error}")
    p.add_argument("--model", required=True, help="module:function(prompt) or module:function(system prompt, prompt) -> reply")
    p.add_argument("--prompt-file", help="a file whose text is the system prompt")
    p.add_argument("--language", help="the code of the language for comments")
    p.add_argument("--provider", default="", help="the provider's key, as it is logged")
    p.add_argument("--post", help="module:function(url, headers, body) -> (status, reply), for the log")
    p.add_argument("--log-base", default="", help="the log service's address")
    p.add_argument("--no-log", action="store_true")
    p = sub.add_parser("select-extract")
    for table in ("links", "targets", "pages"):
        p.add_argument(f"--{table}", required=True)
    p.add_argument("--criterion", default="failed-verification")
    p.add_argument("--after", type=int, default=0)
    p.add_argument("--max", type=int, default=20)
    p.add_argument("--article", required=True, help="module:function(title, revision) -> {html, status, error}")
    p.add_argument("--source", help="module:function(url, page) -> {content, status, error}")
    p.add_argument("--sources", choices=["stub", "live"], default="stub", help="stub: no source is fetched")
    p.add_argument("--output", required=True, help="a folder for the citations, as Parquet")
    return top


def _named(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def compare(spark: SparkSession, a: argparse.Namespace, out) -> int:
    if a.noise_floor < 0:
        raise SystemExit(2)
    control, treatment, dataset = load_results(spark, a.control), load_results(spark, a.treatment), load_dataset(spark, a.dataset)
    cells, coverage = C.cells(control, treatment, dataset).cache(), C.coverage(control, treatment, dataset)
    if coverage.first()["intersection"] == 0:
        print("no entry and provider is in both runs", file=sys.stderr)
        return 2
    if a.filter:
        cells = C.filter_cells(cells, a.filter)
    metadata = {"generated_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "change_axes": a.change_axis, "gt_version": a.gt_version}
    result = reports.comparison(C.provider_stats(cells), cells, coverage, metadata)
    if a.report:
        with open(a.report, "w", encoding="utf-8") as f:
            f.write(reports.render(result, a.report, a.noise_floor))
    print(reports.render_markdown(result, a.noise_floor), file=out)
    return 0


def analyze(spark: SparkSession, a: argparse.Namespace, out) -> int:
    results = load_results(spark, a.results)
    if (a.version or a.projection) and not a.dataset:
        print("--version and --projection need --dataset", file=sys.stderr)
        return 2
    if a.version:
        results = R.of_version(results, load_dataset(spark, a.dataset), a.version)
    if a.projection:
        results = R.of_projection(results, load_dataset(spark, a.dataset), a.projection)
    rows = [r.asDict() for r in M.metrics_by_provider(results).collect()]
    if not rows:
        print("no results to analyze", file=sys.stderr)
        return 2
    text = reports.analysis_markdown(rows, M.best(results).first().asDict())
    matrix = [r.asDict() for r in M.confusion_matrix(results).collect()]
    text += "\n" + "\n\n".join(reports.confusion_text(matrix, r["provider"]) for r in rows) + "\n"
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(reports.analysis_json(rows, M.best(results).first().asDict(), matrix) if a.output.endswith(".json") else text)
    print(text, file=out)
    return 0


def ensemble(spark: SparkSession, a: argparse.Namespace, out) -> int:
    results = load_results(spark, a.results)
    every = E.real_rows(results)
    have = {r["provider"] for r in every.select("provider").distinct().collect()}
    for name, panel in E.PANELS.items():
        if have >= set(panel):
            votes = E.vote_rows(results, panel, E.panel_names(panel))
            print(f"{name}: {votes.count()} rows", file=out)
            every = every.unionByName(votes, allowMissingColumns=True)
    if a.write:
        write_rows(every.drop("pos"), a.results, {"ensembled_at": datetime.now(timezone.utc).isoformat()})
    return 0


def inspect(spark: SparkSession, a: argparse.Namespace, out) -> int:
    scored = load_results(spark, a.results)
    scored = scored.withColumn("correct", F.coalesce("correct", V.score("predicted_verdict", "ground_truth", "error")))
    rows = R.inspect(scored, load_dataset(spark, a.dataset), a.status, a.provider)
    n = rows.count()
    for r in rows.orderBy("entry_id").limit(a.limit).collect():
        print(f"{r['entry_id']}: {r['predicted_verdict']} (truth: {r['ground_truth']}) {r['claim_text'][:100]}", file=out)
    if n > a.limit:
        print(f"... and {n - a.limit} more", file=out)
    return 0


CLAIM = "id string, label string, claim string, evidence array<string>, supporting_sentences array<array<int>>, meta struct<id: string, claim_title: string, claim_section: string, claim_context: string>"


def convert(spark: SparkSession, a: argparse.Namespace, out) -> int:
    splits, schema = [x.strip() for x in a.split.split(",") if x.strip()], _parse_datatype_string(CLAIM)
    rows = None
    for split in splits:
        part = _convert_split(spark, a, split, schema)
        rows = part if rows is None else rows.unionByName(part)
    rows = materialize(rows, "converted")
    write_rows(rows, a.output, {"split": a.split})
    for r in W.summary(rows).orderBy("tally", "value").collect():
        print(f"{r['tally']} {r['value']}: {r['n']}", file=out)
    return 0


def _convert_split(spark: SparkSession, a: argparse.Namespace, split: str, schema) -> DataFrame:
    get = _named(a.download) if a.download else None

    def load(name: str) -> DataFrame:
        name = name.format(split=split)
        return read_jsonl(spark, reachable(spark, locate(name, a.local, a.cache, get)) if a.local or a.download else name, schema)

    claims, subclaims = load(a.claims), load(a.subclaims)
    flat = claims.select(F.col("meta.id").alias("id"), "label", "claim", "evidence", "supporting_sentences", "meta.claim_title", "meta.claim_section", "meta.claim_context")
    subs = subclaims.select(F.regexp_extract("meta.id", "-([0-9]+)$", 1).try_cast("int").alias("pos"), F.col("meta.id").alias("id"), "label")
    return W.convert(flat, subs, split)


def run(spark: SparkSession, a: argparse.Namespace, out) -> int:
    models = _named(a.models)()
    wanted = a.providers.split(",") if a.providers else list(models)
    if unknown := [p for p in wanted if p not in models]:
        print(f"unknown providers: {', '.join(unknown)} (known: {', '.join(models)})", file=sys.stderr)
        return 2
    dataset = load_dataset(spark, a.dataset)
    if a.version:
        dataset = dataset.where(F.col("dataset_version") == a.version)
    if a.limit:
        dataset = R.by_number(dataset).limit(a.limit)
    names = {p: getattr(models[p], "model", None) or (REGISTRY[p].model if p in REGISTRY else p) for p in wanted}
    if (left := saved(spark, a.results)) is not None:  # of a run that ended early
        finish(replaced(load_results(spark, a.results).drop("pos") if exists(spark, a.results) else None, left, ["entry_id", "provider"]), a.results, {"recovered_at": datetime.now(timezone.utc).isoformat()})
    kept = R.reload(load_results(spark, a.results), wanted, resume=a.resume) if exists(spark, a.results) else None  # rows of other providers always stay
    kept = materialize(kept, "kept") if kept is not None else None
    entries = numbered(*ordered(dataset.withColumn("all", F.lit("")), "all", [F.col("id")]), "all").withColumn("part", F.expr(f"node div {a.save_every}")).select(*dataset.columns, "part")
    entries = materialize(entries, "entries")
    for part in range((entries.agg(F.max("part")).first()[0] or 0) + 1):  # a crash loses the part at hand alone
        got = B.run(entries.where(F.col("part") == part).drop("part"), {p: models[p] for p in wanted}, names, a.concurrency, kept)
        save(got.withColumn("timestamp", F.col("timestamp").cast("string")), a.results)  # asked once
    fresh = saved(spark, a.results)
    summary = M.run_summary(fresh, F.col("correct")).orderBy("provider").collect()
    both = kept.drop("pos").unionByName(fresh, allowMissingColumns=True) if kept is not None else fresh
    finish(both, a.results, {"run_at": datetime.now(timezone.utc).isoformat()})
    for r in summary:
        print(f"{r['provider']}: {r['exact']}/{r['total']} exact, {r['partial']} partial, {r['wrong']} wrong, {r['errors']} errors", file=out)
    return 0


#: Headings of the table of citations to check.
HEADINGS = {"Article URL": "article_url", "Citation number": "citation_number", "Citation instance": "occurrence", "Ground truth": "ground_truth", "Dataset version": "dataset_version", "Claim text override": "claim_override", "Source URL override": "url_override"}


def extract(spark: SparkSession, a: argparse.Namespace, out) -> int:
    table = read_csv(spark, a.input, compatible=True).withColumnRenamed("_row", "row")
    for heading, column in HEADINGS.items():
        table = table.withColumn(column, F.nullif(F.col(heading), F.lit("")) if heading in table.columns else F.lit(None).cast("string"))
    rows = table.select("row", "article_url", "citation_number", F.col("occurrence").try_cast("int").alias("occurrence"), "ground_truth", "dataset_version", "claim_override", "url_override")
    if a.version:
        rows = rows.where(F.coalesce("dataset_version", F.lit("v1")) == a.version)
    if a.rows:
        rows = rows.where(F.concat(F.lit("row_"), F.col("row").cast("string")).isin([x.strip() for x in a.rows.split(",") if x.strip()]))
    if a.limit:
        rows = rows.orderBy("row").limit(a.limit)
    if a.dry_run:
        print(f"{rows.count()} citations of {rows.select('article_url').distinct().count()} articles", file=out)
        return 0
    entries = materialize(B.extract_dataset(rows, _named(a.article), _named(a.source)), "dataset")
    write_rows(R.by_number(entries), a.output, {"extracted_at": datetime.now(timezone.utc).date().isoformat(), "version_filter": a.version})
    for r in entries.groupBy("extraction_status").count().orderBy("extraction_status").collect():
        print(f"{r[0]}: {r[1]}", file=out)
    return 0


def select(spark: SparkSession, a: argparse.Namespace, out) -> int:
    links, targets, pages = (spark.read.parquet(p) for p in (a.links, a.targets, a.pages))
    for row in K.candidates(links, targets, pages, K.criterion(a.criterion), a.after, a.max).toJSON().collect():
        print(row, file=out)
    return 0


def sweep(spark: SparkSession, a: argparse.Namespace, out) -> int:
    hours = int(a.lookback_hours) if a.lookback_hours.isdigit() else 48
    now = datetime.now(timezone.utc)
    stamp = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    spark.dataSource.register(RecentChanges)
    log, new, failed = read_log(spark, a.log, stamp(now - timedelta(hours=hours))[:10]), None, []
    for wiki in [w.strip() for w in a.wikis.split(",") if w.strip()]:
        options = {"wikis": wiki, "pages": a.pages, "start": stamp(now - timedelta(hours=hours)), "end": stamp(now)}
        try:
            fresh = materialize(S.sweep(spark.read.format("recent_changes").options(**options).load(), log, a.match, F.lit(stamp(now))), "sweep")
        except Exception as error:  # the other wikis are still swept
            failed.append(wiki)
            print(f"{wiki}: {str(error).splitlines()[0]}", file=sys.stderr)
            continue
        print(f"{wiki}: {fresh.count()} new", file=out)
        log, new = log.unionByName(fresh), fresh if new is None else new.unionByName(fresh)
    if new is not None:
        merge_log(new, a.log)
    return 1 if failed else 0


def verify(spark: SparkSession, a: argparse.Namespace, out) -> int:
    title = spark.range(1).select(wiki_title(F.lit(a.url))).first()[0]
    if not title or not a.number.isdigit():
        print("an article's address and a citation's number are needed", file=sys.stderr)
        return 2
    oldid = dict(x.partition("=")[::2] for x in a.url.partition("?")[2].split("&")).get("oldid", "")
    got = _named(a.article)(title, int(oldid) if oldid.isdigit() else None)
    if not got.get("html"):
        return 3 if got.get("status") == 404 else 4
    page = spark.createDataFrame([(title, got["html"])], "doc_id string, html string")
    cited = X.by_number(X.extract_citations(page), a.number).first()
    if cited is None:
        return 5
    if not cited["url"]:
        return 6
    source = _named(a.source)(cited["url"], cited["page_num"])
    if not source.get("content"):
        return 7
    try:
        reply = _ask(a.model, user_prompt_text(cited["claim_text"], source["content"]), system_prompt(language=a.language, file=a.prompt_file))
    except Exception as error:
        return exit_code(str(error))
    said = parse(reply)
    if said["verdict"] == "PARSE_ERROR":
        return 11
    quote = check_quote(source["content"], said["source_quote"])
    if a.post and not a.no_log:
        entry = spark.createDataFrame([(uuid.uuid4().hex[:8], a.url, title, cited["citation_number"], cited["url"], a.provider, said["verdict"], said["confidence"], said["reason_type"], cited["claim_text"], said["comments"], said["source_quote"], quote["status"], str(oldid))],
            "check_id string, article_url string, article_title string, citation_number string, source_url string, provider string, verdict string, confidence int, reason_type string, claim_text string, comments string, source_quote string, quote_status string, revision_id string")
        if not post_log(a.log_base, log_payload(entry).first().asDict(), _named(a.post)):
            print("the check could not be logged", file=sys.stderr)
    print(f"Claim: {cited['claim_text']}\nSource: {cited['url']}\nVerdict: {said['verdict']} ({said['confidence']})\n{said['comments']}\nQuote: {quote['status']} {quote['verified_text']}".rstrip(), file=out)
    return 0


def select_extract(spark: SparkSession, a: argparse.Namespace, out) -> int:
    """Candidates, their articles and citations, with sources fetched or stubbed."""
    if a.sources == "live" and not a.source:
        print("--sources live needs --source", file=sys.stderr)
        return 2
    links, targets, pages = (spark.read.parquet(p) for p in (a.links, a.targets, a.pages))
    found = materialize(K.candidates(links, targets, pages, K.criterion(a.criterion), a.after, a.max), "candidates")
    source = _named(a.source) if a.sources == "live" else N.stub_source
    articles, citations = N.process(found, _named(a.article), source)
    citations.write.mode("overwrite").parquet(a.output)
    for r in articles.groupBy("outcome").count().orderBy("outcome").collect():
        print(f"{r['outcome']}: {r['count']}", file=out)
    totals = N.extraction_totals(citations).first()
    print(", ".join(f"{k} {totals[k]}" for k in totals.asDict()), file=out)
    return 0


def _ask(model: str, prompt: str, system: str) -> str:
    """The reply of ``module:function``: a function of two takes the system prompt first."""
    call = _named(model)
    return call(system, prompt) if len(inspect_signature(call).parameters) > 1 else call(prompt)


def user_prompt_text(claim: str, content: str) -> str:
    body = content.partition("Source Content:\n")[2] or content
    return f'Claim: "{claim}"\n\nSource text:\n{body}'


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = _parser().parse_args(argv)
    return COMMANDS[a.command](spark or session(), a, out)


COMMANDS = {f.__name__.replace("_", "-"): f for f in (compare, analyze, ensemble, inspect, convert, run, extract, select, select_extract, sweep, verify)}


if __name__ == "__main__":
    sys.exit(main())
