"""Scalar text functions, all inside the JVM."""

from pyspark.sql import functions as F

from inspectlake import settings as S

# White space as the two rule sets define it: the response rules strip every
# Unicode space and the four separator controls, page rules those of a browser.
RESPONSE_SPACE = r"[\s\x1c-\x1f]"
PAGE_SPACE = r"[\t\n\x0B\f\r\p{Zs}\u2028\u2029\ufeff]"


def _drop(col, pattern):
    return F.regexp_replace(col, pattern, "")


def strip(col):
    """Text without leading and trailing Unicode white space."""
    return _drop(col, rf"(?U)^{RESPONSE_SPACE}+|{RESPONSE_SPACE}+\z")


def page_trim(col):
    """Text trimmed the way a browser trims."""
    return _drop(col, rf"^{PAGE_SPACE}+|{PAGE_SPACE}+\z")


def clean_title(col):
    """Trimmed text with every run of white space made one space."""
    return F.regexp_replace(page_trim(col), f"{PAGE_SPACE}+", " ")


def normalize_response(col):
    """The JSON text inside a raw model response.

    Everything from the first ``{`` to the last ``}``; text without a brace
    pair loses only a leading and a trailing fence and outer white space.
    Fences hold no braces, so the usual response needs one pattern.
    """
    braces = F.nullif(F.regexp_extract(col, r"(?s)\{.*\}", 0), F.lit(""))
    unfenced = _drop(col, rf"(?U)^```json{RESPONSE_SPACE}*")
    return F.coalesce(braces, strip(_drop(unfenced, rf"(?U){RESPONSE_SPACE}*```(?=\n?\z)")))


def normalize_field_name(col):
    """Lower case with spaces and hyphens as underscores."""
    return F.translate(F.lower(col), " -", "__")


def cache_key(path, prompt):
    return F.concat(F.lit(S.CACHE_KEY_PREFIX), F.md5(F.concat(path, F.lit(":"), prompt)))


def section_type(cls):
    """Kind of an outline entry, from its class attribute."""
    return (
        F.when(F.contains(cls, F.lit("info_table_section")), "info_table")
        .when(F.contains(cls, F.lit("report_section")), "report_section")
        .otherwise("section")
    )


def indent_level(cls):
    """Outline depth from ``indent-level-N``, 0 without one."""
    digits = F.regexp_extract(cls, r"indent-level-([0-9]+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(0))


def item_title(form_id, prefix):
    return F.concat(F.lit("Action Item "), F.replace(form_id, F.lit(prefix), F.lit("")))


# Fixed formats of the evidence column.
def analyzed(path):
    return F.concat(F.lit("Analyzed "), path)


def failed(error):
    return F.concat(F.lit("Error: "), error)


def processed_pages(count):
    return F.concat(F.lit("Processed "), count.cast("string"), F.lit(" pages"))


def extracted_from(path):
    return F.concat(F.lit("Extracted via LLM from "), path)


def mapped_from(name):
    return F.concat(F.lit("Mapped from "), name)


def mapped_count(count):
    return F.concat(F.lit("Mapped "), count.cast("string"), F.lit(" fields"))
