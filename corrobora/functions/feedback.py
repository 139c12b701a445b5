"""What editors send back: talk-page sections, comment addresses, dataset submissions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrobora.functions.text import collapse, nowiki, revision_id
from corrobora.functions.urls import query_url

#: A submission's fields in order.
SUBMISSION = ["articleUrl", "citationNumber", "claimText", "sourceUrl", "llmVerdict", "llmRationale", "llmProvider", "llmModel", "fetchStatus", "editorHandle", "notes", "llmQuote", "llmQuoteVerified"]
PLACEHOLDER = "PLACEHOLDER"


def _text(c: Column | None) -> Column:
    return collapse(F.coalesce((c if c is not None else F.lit(None)).cast("string"), F.lit("")))


def section_title(article: Column, citation: Column, check: Column) -> Column:
    """The heading of a talk-page section."""
    number = collapse(F.regexp_replace(F.coalesce(citation.cast("string"), F.lit("")), r"[^\w.,\s-]", ""))
    title = F.coalesce(F.nullif(_text(article), F.lit("")), F.lit("Unknown article"))
    return F.concat(F.lit("Feedback: "), title, F.when(number != "", F.concat(F.lit(" ["), number, F.lit("]"))).otherwise(""), F.lit(" (check "), F.coalesce(check, F.lit("unknown")), F.lit(")"))


def section_body(fields: Mapping[str, Column], marker: str = "check") -> Column:
    """A section's text: the check's details where known, the editor's verdict, and a place to explain.

    fields: article_url, article_title, citation_number, claim_text, source_url,
    verdict, comments, provider, model, corrected_verdict, check_id, revision_id,
    revision_url; each may be missing. ``marker`` names the hidden line by which
    a section and its check are joined.
    """
    get = lambda n: fields.get(n, F.lit(None).cast("string"))
    has = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    url, cite, rev = get("article_url"), _text(get("citation_number")), revision_id(get("revision_id")).cast("string")
    label = F.coalesce(F.nullif(_text(get("article_title")), F.lit("")), _text(url))
    rev_text = F.when(rev.isNull(), "").when(has(get("revision_url")), F.concat(F.lit(", revision ["), get("revision_url"), F.lit(" "), rev, F.lit("]"))).otherwise(F.concat(F.lit(", revision "), rev))
    article = F.when(has(url), F.concat(F.lit("* '''Article:''' ["), url, F.lit(" "), label, F.lit("]"), F.when(cite != "", F.concat(F.lit(", citation ["), cite, F.lit("]"))).otherwise(""), rev_text))
    by = F.concat_ws(", ", F.nullif(_text(get("provider")), F.lit("")), F.nullif(_text(get("model")), F.lit("")))
    lines = [
        article, F.when(has(get("source_url")), F.concat(F.lit("* '''Source:''' "), get("source_url"))),
        F.when(has(get("verdict")), F.concat(F.lit("* '''Tool's verdict:''' "), _text(get("verdict")), F.when(by != "", F.concat(F.lit(" ("), by, F.lit(")"))).otherwise(""))),
        F.when(nowiki(get("claim_text")) != "", F.concat(F.lit("* '''Claim checked:''' "), nowiki(get("claim_text")))), F.when(nowiki(get("comments")) != "", F.concat(F.lit("* '''Tool's reasoning:''' "), nowiki(get("comments")))),
    ]
    details = F.concat_ws("\n", *lines)
    return F.concat_ws(
        "\n\n", F.when(details != "", F.concat(F.lit("{{hidden begin|title=Check details}}\n"), details, F.lit("\n{{hidden end}}"))),
        F.when(has(get("corrected_verdict")), F.concat(F.lit("'''Editor says it should be:''' "), _text(get("corrected_verdict")))),
        F.lit("'''Editor's explanation:''' <!-- Write your explanation here, then sign and publish. -->"), F.concat(F.lit(f"<!-- {marker}: "), F.coalesce(get("check_id"), F.lit("unknown")), F.lit(" -->")),
    )


def comment_url(fields: Mapping[str, Column], talk_page: str, preload: str, base: str = "https://en.wikipedia.org/w/index.php") -> Column:
    """The address of a new section's form, filled in."""
    get = lambda n: fields.get(n, F.lit(None).cast("string"))
    title = section_title(get("article_title"), get("citation_number"), get("check_id"))
    parts = [("title", F.lit(talk_page)), ("action", F.lit("edit")), ("section", F.lit("new")), ("preloadtitle", title), ("preload", F.lit(preload)), ("preloadparams[]", section_body(fields))]
    return query_url(base, parts)


def submission_url(form: str, entries: Mapping[str, str], fields: Mapping[str, Column]) -> Column:
    """A prefilled form's address: fields in order, without blank ones and those whose entry is a placeholder."""
    parts = [("usp", F.lit("pp_url"))] + [(entries[n], fields[n]) for n in SUBMISSION if n in fields and entries.get(n) and PLACEHOLDER not in entries[n]]
    return query_url(form, parts)


def submission_configured(form: str, entries: Mapping[str, str], optional: tuple[str, ...] = ("llmQuote", "llmQuoteVerified")) -> bool:
    """Whether the form and every entry that is not optional are real ones."""
    return bool(form) and PLACEHOLDER not in form and all(n in optional or (v and PLACEHOLDER not in v) for n, v in entries.items())


def duration(milliseconds: Column, language: str = "en") -> Column:
    seconds = F.round(milliseconds / 1000).cast("long")
    minutes, rest = F.floor(seconds / 60).cast("string"), (seconds % 60).cast("string")
    if language == "fr":
        return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s"))).otherwise(F.concat(minutes, F.lit(" min "), rest, F.lit(" s")))
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(minutes, F.lit("m "), rest, F.lit("s")))
