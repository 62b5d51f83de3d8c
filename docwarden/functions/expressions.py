"""Scalar rules as Column expressions, all within whole-stage code generation where Spark has the function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that Python's float() reads, without infinities and NaN.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
TRUNCATED = 500


def truncated_heading(heading: Column, most: int = TRUNCATED) -> Column:
    return F.when(F.length(heading) > most, F.concat(F.substring(heading, 1, most - 3), F.lit("..."))).otherwise(heading)


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) > 0, text)


def normalized(raw: Column) -> Column:
    """A value as text to compare: trimmed, one pair of quotes off, lower-cased; booleans, null words and numbers in one spelling each.

    1 and 0 count as booleans before they count as numbers."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"""^(["'])(?s)(.*)\1$""", "$2")
    low = F.lower(text)
    number = F.regexp_replace(low, "_", "").try_cast("double")
    return (
        F.when(raw.isNull(), F.lit("none"))
        .when(low.isin("true", "1"), "true")
        .when(low.isin("false", "0"), "false")
        .when(low.isin("none", "null", "nil"), "none")
        .when(low.rlike(NUMBER), F.concat(F.lit("#"), (number + F.lit(0.0)).cast("string")))
        .when(low.rlike(r"^[+-]?(inf|infinity|nan)$"), F.concat(F.lit("#"), F.regexp_replace(F.regexp_replace(low, r"^\+", ""), "infinity", "inf")))
        .otherwise(low)
    )


def same_default(claimed: Column, actual: Column) -> Column:
    return normalized(claimed) == normalized(actual)


def found_param(params: Column, name: Column) -> Column:
    """The first parameter of that name, whatever the case; null if none."""
    return F.try_element_at(F.filter(params, lambda p: F.lower(p["name"]) == F.lower(name)), F.lit(1))


def has_keywords(params: Column) -> Column:
    return F.exists(params, lambda p: p["kind"] == "VAR_KEYWORD")


def _outcome(status: str | Column, actual: Column | None = None, claimed: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), (none if actual is None else actual).alias("actual_value"), (none if claimed is None else claimed).alias("claimed_value"))


def verified_signature(names: Column, params: Column) -> Column:
    """Claimed parameter names against the actual ones; order and number don't count."""
    actual = F.array_join(F.array_sort(F.transform(params, lambda p: p["name"])), ", ")
    claimed = F.array_join(F.array_sort(names), ", ")
    known = F.transform(params, lambda p: F.lower(p["name"]))
    missing = F.exists(names, lambda n: ~F.array_contains(known, F.lower(n)))
    return (
        F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) == 0, _outcome("Unverifiable"))
        .when(missing & ~has_keywords(params), _outcome("Contradicted", actual, claimed))
        .when(missing, _outcome("Unverifiable", actual, claimed))
        .otherwise(_outcome("Verified", actual, claimed))
    )


def verified_default(name: Column, default: Column, params: Column) -> Column:
    p = found_param(params, name)
    return (
        F.when(name.isNull() | default.isNull(), _outcome("Unverifiable"))
        .when(p.isNull() & has_keywords(params), _outcome("Unverifiable", F.lit("parameter not found"), default))
        .when(p.isNull(), _outcome("Contradicted", F.lit("parameter not found"), default))
        .when(~p["has_default"], _outcome("Contradicted", F.lit("no default"), default))
        .when(~p["is_literal"], _outcome("Unverifiable", p["default_repr"], default))
        .when(same_default(default, p["default_repr"]), _outcome("Verified", p["default_repr"], default))
        .otherwise(_outcome("Contradicted", p["default_repr"], default))
    )


def verified_return(claimed: Column, actual: Column) -> Column:
    """Verified if the claimed type's text is part of the actual one's."""
    return (
        F.when(F.coalesce(claimed, F.lit("")).eqNullSafe("") | F.coalesce(actual, F.lit("")).eqNullSafe(""), _outcome("Unverifiable", actual, claimed))
        .when(normalized(actual).contains(normalized(claimed)), _outcome("Verified", actual, claimed))
        .otherwise(_outcome("Contradicted", actual, claimed))
    )


def module_path(file_path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(file_path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.when(file_path.endswith(".py"), F.translate(stem, "/", "."))


def matches_guess(symbol: Column, guess: Column) -> Column:
    return (symbol == guess) | symbol.endswith(F.concat(F.lit("."), guess))


def signature_line(source: Column) -> Column:
    return F.regexp_extract(source, r"(?m)^[^\S\n]*(?:def |async def |class ).*$", 0)


#: Embedding texts are joined by a backslash and an n, two characters, as their consumers expect.
JOINER = "\\n"
#: Unicode's space separators; Spark's trim takes off U+0020 alone unless it is given others.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def without_spaces_around(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def code_embedding_text(symbol_type: Column, symbol_name: Column, docstring: Column, source: Column) -> Column:
    return F.trim(F.concat_ws(JOINER, F.concat_ws(" ", symbol_type, symbol_name), F.nullif(docstring, F.lit("")), F.nullif(signature_line(source), F.lit(""))))


def doc_embedding_text(heading: Column, text: Column) -> Column:
    return without_spaces_around(F.concat_ws(JOINER, F.nullif(heading, F.lit("")), F.nullif(text, F.lit(""))))


def query_text(claim: Column, guess: Column) -> Column:
    """What is looked for: the claim, and the symbol that it names."""
    return F.when(F.coalesce(guess, F.lit("")) != "", F.concat(claim, F.lit("\nSymbol: "), guess)).otherwise(claim)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    n = norm(vector)
    return F.when(n == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unverifiable_reason(claim_type: Column, symbol: Column, actual: Column, claimed: Column) -> Column:
    return (
        F.when(claim_type == "behavior", "behavior claims cannot be checked mechanically")
        .when(symbol.isNull(), "no confident match to a symbol")
        .when(actual.isNull() & claimed.isNull(), "value extraction failed")
        .otherwise("symbol or value could not be resolved")
    )


#: Directories that no discovery enters.
EXCLUDED = (".git", "__pycache__", ".venv", "venv", "env", ".tox", "build", "dist", ".eggs", "node_modules", ".mypy_cache", ".pytest_cache")


def _parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "[^/]*$", ""), "/")


def in_excluded_dir(path: Column) -> Column:
    return F.arrays_overlap(_parts(path), F.array(*map(F.lit, EXCLUDED))) | path.rlike(r"\.egg-info/")


def is_code_file(path: Column) -> Column:
    """Python files outside of test directories (by the path within the repository) that aren't tests themselves."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    tests = F.arrays_overlap(_parts(path), F.array(*map(F.lit, ("test", "tests", "testing"))))
    return ~in_excluded_dir(path) & ~tests & name.endswith(".py") & ~name.startswith("test_") & ~name.endswith("_test.py")


def is_doc_file(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, "[^/]*$", 0))
    return ~in_excluded_dir(path) & (name.rlike(r"\.(md|markdown|rst)$") | name.isin("readme", "changelog", "contributing", "authors")) & ~name.isin("license", "license.md", "license.txt")
