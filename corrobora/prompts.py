"""What a model is asked for: the reply that this library can read, and nothing about how to judge.

The form of a reply is generated from ``FIELDS`` and ``SCALE``, the same names
that :mod:`corrobora.functions.replies` parses and the quote check looks up.
How to judge is the user's: guidance is a text of their own, given by a file or
by ``guidance``, and goes before the form. A file may also replace all of it.
"""

from __future__ import annotations

#: Verdicts with the confidence that goes with each, as replies state them.
SCALE = (("SUPPORTED", 80, 100), ("PARTIALLY SUPPORTED", 50, 79), ("NOT SUPPORTED", 1, 49), ("SOURCE UNAVAILABLE", 0, 0))
#: A reply's fields with their JSON types, and the reasons.
FIELDS = (("confidence", "number"), ("verdict", "string"), ("reason_type", "string"), ("source_quote", "string"), ("comments", "string"))
REASONS = ("contradiction", "omission")
#: Separates the parts of a quote that stand apart in the source; see ``functions.quotes``.
JOINT = " ... "


def reply_form(group: bool = False) -> str:
    """The reply's form, field by field, as the parser reads it."""
    bands = "; ".join(f"{verdict}: {low}" if low == high else f"{verdict}: {low} to {high}" for verdict, low, high in SCALE)
    shape = ", ".join(f'"{name}": <{kind}>' for name, kind in FIELDS)
    meaning = {
        "confidence": f"depends on the verdict ({bands})",
        "verdict": "one of " + ", ".join(verdict for verdict, *_ in SCALE),
        "reason_type": f"{' or '.join(REASONS)} with {SCALE[2][0]}, else absent",
        "source_quote": f"characters of {'one source' if group else 'the source'} without any change, parts joined by {JOINT!r}; a program looks them up; may be empty",
        "comments": "free text" + (", naming the source of the quote" if group else ""),
    }
    return "Answer with this JSON object alone:\n{" + shape + "}\n" + "\n".join(f"{name}: {meaning[name]}" for name, _ in FIELDS)


def _file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not text.strip():
        raise ValueError(f"the prompt file is empty: {path}")
    return text


def system_prompt(group: bool = False, language: str | None = None, file: str | None = None, guidance: str | None = None) -> str:
    """Task, the user's guidance if any, and the reply's form; or a file's text in their place. With a language, comments are asked for in it while verdicts stay as they are."""
    if file:
        text = _file(file)
    else:
        task = "Input: a claim and " + ("several labelled sources. Output: how far the sources, taken as one, bear the claim out." if group else "a source text. Output: how far the source bears the claim out.")
        text = "\n\n".join(part for part in (task, guidance, reply_form(group)) if part)
    if language and language.split("-")[0].lower() != "en":
        text += f"\n\ncomments: in the language with the code {language}; verdict and field names stay in English, source_quote stays in the source's language."
    return text
