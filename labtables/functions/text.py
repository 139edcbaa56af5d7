"""Fields read out of names, ids and log texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labtables import schemas as S
from labtables.functions._cols import (
    ColumnOrName,
    as_col,
    blank_to_null,
    case_lookup,
    null_to_blank,
)


def last_token(text: ColumnOrName, separator: str = "-") -> Column:
    """Text after the last separator; the whole text when there is none."""
    return F.substring_index(as_col(text), separator, -1)


def sample_barcode(library_prep: ColumnOrName, prep: str = "A") -> Column:
    """Barcode set of a plate: last ``-`` token of the barcode of one prep."""
    barcode = F.try_element_at(as_col(library_prep), F.lit(prep))["barcode"]
    return last_token(blank_to_null(barcode))


def date_token(flowcell: ColumnOrName) -> Column:
    """What stands in front of the first ``_``."""
    return F.substring_index(as_col(flowcell), "_", 1)


def date_digits(token: Column) -> Column:
    """``yyyymmdd`` of a token of eight or six digits; null for anything else."""
    century = F.when(F.substring(token, 1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    return F.when(token.rlike("^[0-9]{8}$"), token).when(
        token.rlike("^[0-9]{6}$"), F.concat(century, token)
    )


def digits_date(digits: Column) -> Column:
    day = F.try_make_timestamp_ntz(
        F.substring(digits, 1, 4).cast("int"),
        F.substring(digits, 5, 2).cast("int"),
        F.substring(digits, 7, 2).cast("int"),
        F.lit(0),
        F.lit(0),
        F.lit(0),
    )
    return day.cast("date")


def flowcell_date(flowcell: ColumnOrName) -> Column:
    """Run date in front of the first ``_``: ``yyyymmdd`` or ``yymmdd``.

    Two-digit years pivot at 1969, so 97 is 1997 and 24 is 2024.  Anything else
    is null.
    """
    return digits_date(date_digits(date_token(flowcell)))


def flowcell_ages(flowcells: Column) -> Column:
    """Negated run day of each flowcell of an array, worked out step by step, each step once."""
    digits = F.transform(F.transform(flowcells, date_token), date_digits)
    return F.transform(digits, lambda d: -F.unix_date(digits_date(d)))


def read_layout(setup: ColumnOrName) -> Column:
    """``R1-I1-I2-R2`` cycle counts to the four read segment descriptions.

    Null unless there are exactly four parts.
    """
    parts = F.split(as_col(setup), "-")
    part = [F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3, 4)]
    layout = F.struct(
        F.format_string("cDNA(23-%s)", part[0]).alias("r1_cdna"),
        F.lit("UMI(12-19)").alias("r1_umi"),
        F.format_string("cDNA(1-%s)", part[3]).alias("r2"),
        F.format_string("BC(1-%s)", part[1]).alias("i1"),
        F.format_string("BC(1-%s)", part[2]).alias("i2"),
    )
    return F.when(F.size(parts) == 4, layout)


def species_key(genome: ColumnOrName, organism: ColumnOrName) -> Column:
    """Latin species name in a genome text, else the organism field.

    The name is what follows the first ``(`` before the first comma.  A given
    genome without ``(`` is unreadable and yields null; an empty name, ``-`` or
    ``other`` falls back to the organism.
    """
    genome = as_col(genome)
    given = (null_to_blank(genome) != "") & (genome != S.UNSPECIFIED_GENOME)
    head = F.substring_index(genome, ",", 1)
    name = F.lower(F.trim(F.substring_index(F.substring_index(head, "(", 2), "(", -1)))
    fallback = blank_to_null(F.lower(F.trim(as_col(organism))))
    return (
        F.when(~given, fallback)
        .when(~F.contains(head, F.lit("(")), F.lit(None).cast("string"))
        .when(name.isin("", "-", "other"), fallback)
        .otherwise(name)
    )


def organism_common(
    genome: ColumnOrName, organism: ColumnOrName, supported: list[str]
) -> Column:
    """Common species name: genome text before ``(``, else the organism field.

    Either candidate counts only when supported; null means the project cannot
    go on by itself.
    """
    genome = F.trim(null_to_blank(genome))
    first = F.lower(F.trim(F.substring_index(genome, "(", 1)))
    first_usable = (
        (genome != "")
        & (F.lower(genome) != S.UNSPECIFIED_GENOME.lower())
        & first.isin(*supported)
    )
    second = F.lower(F.trim(null_to_blank(organism)))
    second_usable = (second != "") & second.isin(*supported)
    return F.when(first_usable, first).when(second_usable, second)


def default_feature(method: ColumnOrName) -> Column:
    """Feature implied by the method text alone."""
    method = null_to_blank(method)
    gex = F.lit(False)
    for pattern in S.GEX_METHOD_PATTERNS:
        gex = gex | F.contains(method, F.lit(pattern))
    return (
        F.when(gex, F.lit("gex"))
        .when(F.contains(method, F.lit(S.ATAC_METHOD_PATTERN)), F.lit("atac"))
        .otherwise(F.lit("unknown"))
    )


def feature_and_origin(
    case_type: ColumnOrName,
    sample_id: ColumnOrName,
    customer_name: ColumnOrName,
    prep_option: ColumnOrName,
    prep_method: ColumnOrName,
    suffixes: list[tuple[str, str]],
    last_chars: dict[str, str],
) -> Column:
    """Feature of a lab sample and the id of the sample it came from.

    Old format: the first configured ``_suffix`` found in the customer name
    decides, the origin is what precedes it.  New format: the last character
    of the id decides, the origin is the rest.  Unknown either way: feature
    from the method text, origin is the sample itself.
    """
    sample_id, customer_name = as_col(sample_id), null_to_blank(customer_name)
    none = F.lit(None).cast("string")

    old_feature, old_origin = none, none
    for suffix, feature in reversed(suffixes):
        token = f"_{suffix}"
        found = F.contains(customer_name, F.lit(token))
        old_feature = F.when(found, F.lit(feature)).otherwise(old_feature)
        old_origin = F.when(
            found, F.substring_index(customer_name, token, 1)
        ).otherwise(old_origin)

    new_feature = case_lookup(F.right(sample_id, F.lit(1)), last_chars, none)
    rest = F.left(sample_id, F.length(sample_id) - 1)
    new_origin = F.when(F.length(sample_id) > 1, rest).otherwise(F.lit("unknown_sample_id"))

    old = as_col(case_type) == "old_format"
    feature = F.when(old, old_feature).otherwise(new_feature)
    origin = F.when(old, old_origin).otherwise(new_origin)
    fallback = default_feature(F.when(old, as_col(prep_option)).otherwise(as_col(prep_method)))
    known = feature.isNotNull() & (feature != "unknown")
    return F.struct(
        F.when(known, feature).otherwise(fallback).alias("feature"),
        F.when(known, origin).otherwise(sample_id).alias("origin"),
    )


def base_name(path: ColumnOrName) -> Column:
    return F.substring_index(as_col(path), "/", -1)


def fastq_role(path: ColumnOrName) -> Column:
    """R1, R2, I1 or I2 of a sequence file, null for other files."""
    name = base_name(path)
    suffix_ok = F.lit(False)
    for suffix in S.FASTQ_SUFFIXES:
        suffix_ok = suffix_ok | F.endswith(name, F.lit(suffix))
    role = None
    # In order of precedence, in case a name holds two of the marks.
    for word in ("R1", "R2", "I1", "I2"):
        hit = suffix_ok & F.contains(name, F.lit(f"_{word}_"))
        role = F.when(hit, F.lit(word)) if role is None else role.when(hit, F.lit(word))
    return role


def job_id_from_text(text: ColumnOrName) -> Column:
    """First run of digits in what the scheduler printed."""
    return blank_to_null(F.regexp_extract(as_col(text), r"([0-9]+)", 1))


def run_succeeded(text: ColumnOrName, marker: str = S.RUN_SUCCESS_MARKER) -> Column:
    return F.coalesce(F.contains(as_col(text), F.lit(marker)), F.lit(False))


def report_path(
    text: ColumnOrName, patterns: tuple[str, ...] = S.REPORT_PATH_PATTERNS
) -> Column:
    """First hit of the patterns, tried in order, anywhere in the text."""
    hits = [blank_to_null(F.regexp_extract(as_col(text), p, 1)) for p in patterns]
    return F.coalesce(*hits)


def tool_version(
    text: ColumnOrName,
    phrase: str = S.TOOL_VERSION_PHRASE,
    default: str = S.TOOL_VERSION_DEFAULT,
) -> Column:
    """Last whitespace token of the last line that holds the phrase.

    Works on the last occurrence of the phrase only, so a long log is not
    split into lines first.
    """
    text = as_col(text)
    after = F.substring_index(text, phrase, -1)
    before = F.left(text, F.length(text) - F.length(after) - F.lit(len(phrase)))
    line = F.concat(
        F.substring_index(before, "\n", -1),
        F.lit(phrase),
        F.substring_index(after, "\n", 1),
    )
    token = F.regexp_extract(line, r"(\S+)\s*$", 1)
    return F.when(F.contains(text, F.lit(phrase)), token).otherwise(F.lit(default))


def log_facts(
    line: str = "line",
    place: str = "place",
    marker: str = S.RUN_SUCCESS_MARKER,
    patterns: tuple[str, ...] = S.REPORT_PATH_PATTERNS,
    phrase: str = S.TOOL_VERSION_PHRASE,
    default: str = S.TOOL_VERSION_DEFAULT,
) -> list[Column]:
    """Outcome, report path and tool version of a log, as aggregates of its lines.

    What :func:`run_succeeded`, :func:`report_path` and :func:`tool_version` say of the whole
    text, by partial aggregation, so that no log has to be in one place.  A report path
    stands on the line of its mark.
    """
    value, at = F.col(line), F.col(place)
    hits = [blank_to_null(F.regexp_extract(value, p, 1)) for p in patterns]
    first = [F.min_by(hit, F.when(hit.isNotNull(), at)) for hit in hits]
    last = F.max_by(value, F.when(F.contains(value, F.lit(phrase)), at))
    return [
        F.bool_or(F.contains(value, F.lit(marker))).alias("succeeded"),
        F.coalesce(*first).alias("report_path"),
        F.when(last.isNull(), F.lit(default)).otherwise(tool_version(last, phrase, default)).alias("version"),
    ]
