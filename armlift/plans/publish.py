"""The published document: chosen fields of all result tables as one JSON object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from armlift.sources.results import Tables, document, read_results, section

# section of the document: (result table, chosen fields with new names, key of nested lists)
CONTENTS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "profile_rows": ("rows", {"n": "rows_written", "read": "rows_read"}, None),
    "profile_groups": ("arm_sizes", {"treatment": "treatment", "n": "n"}, None),
    "profile_means": ("binary_means", {"column": "column", "mean": "mean"}, None),
    "profile_nulls": ("missing", {"column": "column", "nulls": "n_null"}, None),
    "profile_nulls_total": ("missing_total", {"nulls": "n_null"}, None),
    "profile_checks": ("consistency", {"check": "check", "violations": "n_violations"}, None),
    "profile_duplicates": (
        "duplicates",
        {"dup_share": "try_divide(cast(duplicate_rows as double), cast(n as double))"},
        None,
    ),
    "srm": (
        "srm",
        {
            c: c
            for c in (
                "n_treatment",
                "n_control",
                "design_share",
                "observed_share",
                "ci_lo",
                "ci_hi",
                "chi2",
                "p_value",
                "alpha",
                "srm_detected",
            )
        },
        None,
    ),
    "balance": ("balance", {"feature": "feature", "smd": "smd", "vr": "variance_ratio", "p": "welch_p"}, None),
    "ab": (
        "lift",
        {
            "metric": "metric",
            "rate_c": "rate_control",
            "rate_t": "rate_treatment",
            "abs": "abs_lift",
            "abs_ci": "array(abs_lo, abs_hi)",
            "rel": "rel_lift",
            "rel_ci": "array(rel_lo, rel_hi)",
            "z": "z",
            "p": "p_value",
        },
        "metric",
    ),
    "ab_boot": ("lift_bootstrap", {"metric": "metric", "rel_ci_boot": "array(boot_rel_lo, boot_rel_hi)"}, "metric"),
    "power_settings": ("power_settings", {"alpha": "alpha", "target": "target"}, None),
    "power": (
        "power_grid",
        {"metric": "metric", "f": "fraction", "n": "n_total", "mde": "mde_rel", "power": "power"},
        "metric",
    ),
    "power_empirical": (
        "empirical_power",
        {"metric": "metric", "k": "k", "f": "fraction", "emp": "empirical_power", "ana": "analytic_power"},
        "metric",
    ),
    "allocation": ("units_needed", {"metric": "metric", "n_actual": "n_actual", "n_even": "n_even"}, "metric"),
    "cace": (
        "effects",
        {
            "metric": "metric",
            "compliance": "compliance",
            "itt": "itt",
            "cace": "cace",
            "naive": "naive_vs_control",
            "rate_exposed": "rate_exposed",
            "rate_without_ad": "rate_without_exposure",
            "cace_rel": "cace_rel",
        },
        "metric",
    ),
    "cace_itt_ci": ("effect_intervals", {"metric": "metric", "itt_ci": "array(itt_lo, itt_hi)"}, "metric"),
    "cace_boot": (
        "effect_bootstrap",
        {
            "metric": "metric",
            "cace_ci": "array(boot_cace_lo, boot_cace_hi)",
            "naive_ci": "array(boot_naive_vs_control_lo, boot_naive_vs_control_hi)",
        },
        "metric",
    ),
    "segments": (
        "segments",
        {
            "feature": "feature",
            "bucket": "bucket",
            "metric": "metric",
            "range": "`range`",
            "n": "n",
            "rate_c": "rate_control",
            "rate_t": "rate_treatment",
            "lift": "lift",
            "se": "se",
            "p_bh": "p_bh",
        },
        "feature",
    ),
    "segment_edges": ("segment_edges", {"feature": "feature", "position": "position", "edge": "edge"}, "feature"),
    "heterogeneity": (
        "heterogeneity",
        {
            "feature": "feature",
            "metric": "metric",
            "n_buckets": "n_buckets",
            "Q": "q",
            "p_bonf": "p_bonferroni",
            "lift_range": "lift_range",
        },
        None,
    ),
    "uplift": ("qini", {"metric": "metric", "qini_coef": "qini"}, "metric"),
    "uplift_capture": ("capture", {"metric": "metric", "share": "share", "capture": "capture"}, "metric"),
    "uplift_capture_ci": (
        "capture_bootstrap",
        {"metric": "metric", "share": "share", "ci": "array(boot_capture_lo, boot_capture_hi)"},
        "metric",
    ),
    "uplift_curve": ("qini_curve", {"metric": "metric", "point": "point", "phi": "phi", "q": "q_share"}, "metric"),
    "uplift_deciles": (
        "deciles",
        {
            c: c
            for c in ("metric", "decile", "predicted_uplift", "observed_uplift", "ci_lo", "ci_hi", "n")
        },
        "metric",
    ),
    "sample": ("sample_sizes", {"is_test": "is_test", "n": "n"}, None),
}


def chosen(tables: Tables, title: str) -> DataFrame:
    table, fields, _ = CONTENTS[title]
    return tables[table].selectExpr(*[f"{value} as `{field}`" for field, value in fields.items()])


def publish(tables: Tables) -> DataFrame:
    """One row with the JSON of every section whose result table is given."""
    present = [t for t, (table, _, _) in CONTENTS.items() if table in tables]
    return document([section(t, chosen(tables, t), CONTENTS[t][2]) for t in present])


def publish_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The document of the result tables written to a folder."""
    return publish(read_results(spark, folder, {table for table, _, _ in CONTENTS.values()}))


def document_paths(documents: DataFrame) -> DataFrame:
    """(section, key, field, number, text): every value of published documents, members of lists by place.

    The documents are taken apart as variants, so sections of any shape and new fields show up.
    Numbers are doubles; texts and flags are texts. Values that are null are left out.
    """
    return documents.sparkSession.sql(
        """
        with sections as (
          select s.key as section, s.value as body, schema_of_variant(s.value) like 'ARRAY%' as is_list
          from {docs}, lateral variant_explode(parse_json(document)) s),
        lists as (
          select section, cast(null as string) as key, body as items from sections where is_list
          union all
          select section, k.key, k.value from sections, lateral variant_explode(body) k where not is_list),
        records as (select section, l.key, r.value as record from lists l, lateral variant_explode(items) r),
        fields as (select section, r.key, f.key as field, f.value from records r, lateral variant_explode(record) f),
        leaves as (
          select section, f.key, if(m.pos is null, field, concat(field, '[', m.pos, ']')) as field,
            if(m.pos is null, f.value, m.value) as leaf
          from fields f, lateral variant_explode_outer(f.value) m),
        typed as (select *, schema_of_variant(leaf) as kind from leaves)
        select section, key, field,
          if(kind in ('STRING', 'BOOLEAN'), null, cast(leaf as double)) as number,
          if(kind in ('STRING', 'BOOLEAN'), cast(leaf as string), null) as text
        from typed where kind <> 'VOID'
        """,
        docs=documents,
    )
