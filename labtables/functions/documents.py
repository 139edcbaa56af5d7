"""Fields of project and tracking documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables.functions._cols import ColumnOrName, as_col, null_to_blank

# Column name -> document field of the four options the new format adds.
NEW_FORMAT_OPTIONS = {
    "hashing": "library_prep_option_single_cell_hashing",
    "cite": "library_prep_option_single_cell_cite",
    "vdj": "library_prep_option_single_cell_vdj",
    "feature": "library_prep_option_single_cell_feature",
}


def project_info(docs: DataFrame, *keep: str) -> DataFrame:
    """Flat project columns with their defaults, one row per document.

    A filled prep option marks the old format; only the new format has the four
    extra options (null in the old one).
    """
    prep_option = null_to_blank("details.library_prep_option")
    old = prep_option != ""
    extras = [
        F.when(~old, F.coalesce(F.col(f"details.{field}"), F.lit("None"))).alias(name)
        for name, field in NEW_FORMAT_OPTIONS.items()
    ]
    return docs.select(
        *keep,
        null_to_blank("project_name").alias("project_name"),
        F.coalesce("project_id", F.lit("Unknown_Project")).alias("project_id"),
        null_to_blank("customer_project_reference").alias("customer_reference"),
        null_to_blank("details.library_construction_method").alias("library_prep_method"),
        prep_option.alias("library_prep_option"),
        null_to_blank("reference_genome").alias("reference_genome"),
        null_to_blank("details.organism").alias("organism"),
        null_to_blank("contact").alias("contact"),
        F.when(old, F.lit("old_format")).otherwise(F.lit("new_format")).alias("case_type"),
        *extras,
    )


def plate_project_info(docs: DataFrame, *keep: str) -> DataFrame:
    """The plate realm's variant: eight columns, nulls kept where not required."""
    return docs.select(
        *keep,
        null_to_blank("project_name").alias("project_name"),
        F.coalesce("project_id", F.lit("Unknown_Project")).alias("project_id"),
        F.col("customer_project_reference").alias("customer_id"),
        F.col("details.library_prep_option").alias("library_prep_option"),
        "contact",
        F.col("reference_genome").alias("ref_genome"),
        F.col("details.organism").alias("organism"),
        F.col("details.sequencing_setup").alias("sequencing_setup"),
    )


def user_info(owner: ColumnOrName, fields: ColumnOrName) -> Column:
    """Role -> (email, name) for owner, bioinformatician, pi and lab.

    The lab's e-mail is read from its e-mail field and its name from its name
    field (the original swaps the two).
    """
    owner, fields = as_col(owner), as_col(fields)

    def entry(email: Column, name: Column) -> Column:
        return F.struct(null_to_blank(email).alias("email"), null_to_blank(name).alias("name"))

    def field(key: str) -> Column:
        return F.try_element_at(fields, F.lit(key))

    return F.create_map(
        F.lit("owner"),
        entry(owner["email"], owner["name"]),
        F.lit("bioinformatician"),
        entry(field("project_bx_email"), field("project_bx_name")),
        F.lit("pi"),
        entry(field("project_pi_email"), field("project_pi_name")),
        F.lit("lab"),
        entry(field("project_lab_email"), field("project_lab_name")),
    )


def is_sensitive(sensitive_data: ColumnOrName) -> Column:
    return F.lower(null_to_blank(sensitive_data)) == "yes"


def contact_email(info: ColumnOrName, role: str) -> Column:
    """E-mail of one role in a user-info map, "" when missing."""
    return null_to_blank(F.try_element_at(as_col(info), F.lit(role))["email"])


def delivery_sensitive(flag: ColumnOrName) -> Column:
    """Deliver as sensitive unless the document says no."""
    return F.coalesce(as_col(flag), F.lit(True))


def field_absent(body: ColumnOrName, path: str) -> Column:
    """True when a dotted path is absent from a VARIANT; a JSON null is present."""
    quoted = "$" + "".join(f"['{key}']" for key in path.split("."))
    return F.try_variant_get(as_col(body), quoted, "variant").isNull()


def missing_fields(body: ColumnOrName, paths: list[str]) -> Column:
    """Required paths a document lacks, in the order they were asked for."""
    return F.array_compact(
        F.array(*[F.when(field_absent(body, path), F.lit(path)) for path in paths])
    )


def has_keys(body: ColumnOrName, keys: tuple[str, ...]) -> Column:
    """All top-level keys present (report entries need every one of theirs)."""
    out = F.lit(True)
    for key in keys:
        out = out & ~field_absent(body, key)
    return out
