"""Claims out of prose: prompts, tolerant parsing of a model's answers, and an offline rule extractor. The model is a callable, text to text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from docwarden.schema import CLAIM_TYPES

PARSED = "claim_text string, claim_type string, referenced_symbol_guess string, error string"
VALUE = "struct<param_names:array<string>,param_count:int,param_name:string,default:string,var_name:string,return_type:string>"
#: Fields of the value of each claim type, and their kind.
FIELDS = {
    "signature": (("param_names", "list"), ("param_count", "int")),
    "default_value": (("param_name", "text"), ("default", "text")),
    "env_var": (("var_name", "text"),),
    "return_type": (("return_type", "text"),),
    "behavior": (),
}


EXAMPLES = (
    ("timeout defaults to 30", "default_value", "connect"),
    ("the client reads API_TOKEN from the environment", "env_var", "Client"),
    ("retries happen in the background", "behavior", None),
)
#: What is asked for, by claim type.
QUESTIONS = {
    "signature": "Which parameter names does this statement give to the function, in order, and how many parameters does it say there are?",
    "default_value": "Which parameter does this statement speak of, and which default does it give it? Write the default as it would stand in the code.",
    "env_var": "Which environment variable does this statement name?",
    "return_type": "Which type does this statement say is returned? Write it as an annotation.",
}


def extraction_prompt(text: str, heading: str | None) -> str:
    shown = json.dumps([dict(zip(("claim_text", "claim_type", "referenced_symbol_guess"), x)) for x in EXAMPLES])
    return f"List the checkable statements about code in this section as a JSON array of objects with claim_text, claim_type (one of {', '.join(CLAIM_TYPES)}) and referenced_symbol_guess (or null).\nExample: {shown}\nAnswer with the array alone, [] if there are none.\n\nSection: {heading or ''}\n{text}"


def value_prompt(claim: str, kind: str) -> str:
    """A question of the claim's type, and the keys of the answer."""
    return f"{QUESTIONS.get(kind, 'What does this statement claim?')}\nAnswer with one JSON object with the keys {', '.join(f for f, _ in FIELDS.get(kind, ()))}, null where it says nothing.\n\n{claim}"


def unfenced(raw: str) -> str:
    return re.sub(r"^```\w*\s*\n?|\n?```\s*$", "", raw.strip()).strip()


def parse_claims(raw: str) -> tuple[list[tuple[str, str, str | None]], list[str]]:
    """Valid claims of an answer, and what was wrong with the rest."""
    text = unfenced(raw or "")
    try:
        items = json.loads(text)
    except ValueError:
        a, b = text.find("["), text.rfind("]")
        try:
            items = json.loads(text[a : b + 1]) if 0 <= a < b else None
        except ValueError:
            items = None
    if not isinstance(items, list):
        return [], ["not a JSON list"]
    good, bad = [], []
    for k, x in enumerate(items):
        if not isinstance(x, dict) or any(f not in x for f in ("claim_text", "claim_type", "referenced_symbol_guess")):
            bad.append(f"item {k}: not an object with the three keys")
        elif not isinstance(x["claim_text"], str) or not x["claim_text"].strip():
            bad.append(f"item {k}: blank text")
        else:
            kind, guess = str(x["claim_type"]).lower(), x["referenced_symbol_guess"]
            good.append((x["claim_text"], kind if kind in CLAIM_TYPES else "behavior", (str(guess) or None) if guess is not None else None))
    return good, bad


def parse_value(raw: str, kind: str) -> dict | None:
    """The claimed value of an answer, coerced to the type's fields; None if it isn't an object."""
    try:
        x = json.loads(unfenced(raw or ""))
    except ValueError:
        return None
    if not isinstance(x, dict):
        return None
    out: dict = {}
    for name, form in FIELDS.get(kind, ()):
        v = x.get(name)
        if form == "list":
            out[name] = [] if v is None else [str(i) for i in v] if isinstance(v, list) else [str(v)]
        elif form == "int":
            try:
                out[name] = None if v is None else int(v)
            except (ValueError, TypeError):
                out[name] = None
        else:
            out[name] = None if v is None else str(v)
    return out


def claims_of(text: str, heading: str | None, model: Callable[[str], str]) -> tuple[list, bool, bool]:
    """Claims of one section, whether parsing failed and whether the model did; one retry, only where nothing was valid and something was wrong."""
    for attempt in range(2):
        try:
            good, bad = parse_claims(model(extraction_prompt(text, heading)))
        except Exception:  # a model's failure, of whatever kind, ends this section only
            return [], False, True
        if good or not bad:
            return good, False, False
    return [], True, False


def rule_model(prompt: str) -> str:
    """Offline stand-in for a model: default, environment, return and signature phrases by pattern."""
    text, out = prompt.rsplit("\nSection: ", 1)[-1].partition("\n")[2], []
    for pattern, kind in ((r"`?(\w+)`? defaults to `?[^\s`.,]+", "default_value"), (r"(?:environment variable|env var) `?([A-Z_]{3,})`?", "env_var"), (r"`?(\w+)`? returns `?[\w\[\], ]+", "return_type"), (r"`(\w+)\(([^)]*)\)`", "signature")):
        out += [{"claim_text": m[0], "claim_type": kind, "referenced_symbol_guess": m[1] if kind in ("signature", "return_type") else None} for m in re.finditer(pattern, text)]
    return json.dumps(out)


def extract_claims(sections: DataFrame, model: Callable[[str], str] = rule_model) -> DataFrame:
    """Claims of sections (repo_id, doc_chunk_id, heading, text); a section without any gives one row with its failure, if it failed."""
    schema = f"repo_id long, doc_chunk_id long, {PARSED}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            rows = []
            for repo, chunk, heading, text in zip(got.repo_id, got.doc_chunk_id, got.heading, got.text.fillna("")):
                good, bad, failed = claims_of(text, heading, model)
                rows += [(repo, chunk, *c, None) for c in good]
                if bad or failed:
                    rows.append((repo, chunk, None, None, None, "model error" if failed else "no valid claim"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return sections.select("repo_id", "doc_chunk_id", "heading", "text").mapInPandas(run, schema)


def parse_answers(answers: DataFrame) -> DataFrame:
    """Valid claims and errors of raw answers (id, raw)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            rows = []
            for i, raw in zip(got.id, got.raw):
                good, bad = parse_claims(raw)
                rows += [(i, *c, None) for c in good] + [(i, None, None, None, e) for e in bad]
            yield pd.DataFrame(rows, columns=["id", "claim_text", "claim_type", "referenced_symbol_guess", "error"])

    return answers.select("id", "raw").mapInPandas(run, f"id long, {PARSED}")


def parse_values(answers: DataFrame) -> DataFrame:
    """Coerced values of raw answers (id, claim_type, raw); value is null where the answer is no object."""
    names = [x.split(":")[0] for x in ("param_names", "param_count", "param_name", "default", "var_name", "return_type")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            values = [parse_value(raw, kind) for raw, kind in zip(got.raw, got.claim_type)]
            yield pd.DataFrame({"id": got.id, "value": [None if v is None else {n: v.get(n) for n in names} for v in values]})

    return answers.select("id", "claim_type", "raw").mapInPandas(run, f"id long, value {VALUE}")
