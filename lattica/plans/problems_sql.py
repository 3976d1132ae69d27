"""SQL twins of the queries of problems 3 to 6, for DuckDB."""

KEY = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"
GENE = "trim(regexp_replace(lower(regexp_replace(trim({0}), '\\.[0-9]+\\s*$', '')), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"


def _found(child: str, field: str, cond: str, canon: str, parent: str, key: str, end: str) -> str:
    return f"""
    SELECT '{child}' AS child_table, '{field}' AS child_field, row_id, loaded_at FROM
      (SELECT row_id, loaded_at, {canon.format(field)} AS k FROM {child} WHERE {field} IS NOT NULL {cond}) c
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {canon.format(key)} AS pk, loaded_at AS ps, {end} AS pe FROM {parent} WHERE {key} IS NOT NULL) p
      WHERE p.pk = c.k AND p.ps <= c.loaded_at AND (p.pe IS NULL OR c.loaded_at < p.pe))"""


_ORPHANS = " UNION ALL ".join(
    [
        _found("expr_signal", "sample_id", "AND coalesce(unit, '') <> 'beataml_aml'", KEY, "sample_attr", "sample_id", "deleted_at"),
        _found("expr_signal", "sample_id", "AND unit = 'beataml_aml'", KEY, "sample_mapping", "dbgap_rnaseq_sample", "removed_at"),
        _found("expr_signal", "gene_id", "", GENE, "gene", "gene_id", "retired_at"),
        _found("contact", "g1", "", GENE, "gene", "gene_id", "retired_at"),
        _found("contact", "g2", "", GENE, "gene", "gene_id", "retired_at"),
        _found("beataml_mutation", "dbgap_sample_id", "", KEY, "sample_mapping", "dbgap_dnaseq_sample", "removed_at"),
    ]
)

_FIELDS = """
  SELECT row_id, load_no, 'rin' AS f, cast(rin AS varchar) AS t, rin AS x, rin >= 1 AND rin <= 10 AND NOT isnan(rin) AS ok FROM sample_attr
  UNION ALL SELECT row_id, load_no, 'ischaemic', cast(ischaemic AS varchar), ischaemic, ischaemic >= -1440 AND ischaemic <= 2880 AND NOT isnan(ischaemic) FROM sample_attr
  UNION ALL SELECT row_id, load_no, 'batch_na', batch_na, NULL, regexp_full_match(batch_na, 'BP-[0-9]{5}') FROM sample_attr
  UNION ALL SELECT row_id, load_no, 'batch_ge', batch_ge, NULL, regexp_full_match(batch_ge, 'LCSET-[0-9]{4,5}') FROM sample_attr"""

_EVERY = (
    " UNION ALL ".join(
        [
            _FIELDS,
            *[f"SELECT row_id, load_no, '{c}', cast({c} AS varchar), cast({c} AS double), true FROM sample_attr WHERE {c} IS NOT NULL UNION ALL SELECT row_id, load_no, '{c}', NULL, NULL, NULL FROM sample_attr WHERE {c} IS NULL" for c in ("row_id",)],
            *[f"SELECT row_id, load_no, '{c}', cast({c} AS varchar), epoch({c}), CASE WHEN {c} IS NOT NULL THEN true END FROM sample_attr" for c in ("collected_at", "loaded_at", "deleted_at")],
            "SELECT row_id, load_no, 'tissue', tissue, NULL, CASE WHEN tissue IS NOT NULL THEN true END FROM sample_attr",
            r"SELECT row_id, load_no, 'sample_id', sample_id, NULL, regexp_full_match(sample_id, '[^\p{L}\p{N}]*[\p{L}\p{N}]+([^\p{L}\p{N}]+[\p{L}\p{N}]+)+[^\p{L}\p{N}]*') FROM sample_attr",
        ]
    )
)

_PROFILE = """
  WITH f AS ({fields}),
  c AS (SELECT load_no, f, t, count(*) AS n FROM f WHERE ok GROUP BY load_no, f, t),
  tv AS (SELECT load_no, f, min(t) AS top_value, max(n) AS top_n FROM (SELECT *, max(n) OVER (PARTITION BY load_no, f) AS mx FROM c) z WHERE n = mx GROUP BY load_no, f)
  SELECT p.load_no, p.f AS field_name, n_rows, n_null, n_distinct, n_invalid, n_valid, min_number, max_number, min_text, max_text, top_value, top_n, null_rate, median FROM
   (SELECT load_no, f, count(*) AS n_rows, count(*) - count(t) AS n_null, count(DISTINCT t) AS n_distinct, sum(CASE WHEN NOT ok THEN 1 ELSE 0 END)::bigint AS n_invalid,
      sum(CASE WHEN ok THEN 1 ELSE 0 END)::bigint AS n_valid, min(CASE WHEN ok THEN x END) AS min_number, max(CASE WHEN ok THEN x END) AS max_number, min(t) AS min_text, max(t) AS max_text,
      round((count(*) - count(t)) / count(*), 9) AS null_rate, round(median(CASE WHEN ok THEN x END), 9) AS median FROM f GROUP BY load_no, f) p
   LEFT JOIN tv ON tv.load_no = p.load_no AND tv.f = p.f"""

_DRIFT = f"""
  WITH f AS (SELECT * FROM ({_EVERY}) e WHERE ok),
  v AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS no, count(*) OVER (PARTITION BY f) AS n FROM (SELECT DISTINCT f, x FROM f WHERE x IS NOT NULL) d),
  k AS (SELECT f, list(DISTINCT x) AS cuts FROM v JOIN range(1, 10) i(i) ON no = (i * n + 9) // 10 GROUP BY f),
  b AS (SELECT load_no, f.f, CASE WHEN cuts IS NULL THEN t ELSE cast(len(list_filter(cuts, lambda c: c < x)) AS varchar) END AS cell, count(*) AS n FROM f LEFT JOIN k ON k.f = f.f GROUP BY 1, 2, 3),
  g AS (SELECT *, sum(n) OVER (PARTITION BY load_no, f) AS load_n, sum(n) OVER (PARTITION BY f, cell) AS cell_n, sum(n) OVER (PARTITION BY f) AS all_n FROM b),
  h AS (SELECT *, cell_n * load_n / all_n AS want, greatest(n / load_n, 0.0001) AS here, CASE WHEN all_n > load_n THEN greatest((cell_n - n) / (all_n - load_n), 0.0001) ELSE 0.0001 END AS rest FROM g)
  SELECT load_no, f AS field_name, cast(max(load_n) AS bigint) AS load_n, count(*) AS cells, round(sum((here - rest) * ln(here / rest)), 6) AS psi,
    round(sum((n - want) ** 2 / want) + max(load_n) - sum(want), 4) AS chi_square FROM h GROUP BY load_no, f"""

# every load and field, loads without valid values too, and every cell of a field, those that a load lacks too
_DRIFT_WHOLE = f"""{_DRIFT[: _DRIFT.index("  g AS (")]}
  l AS (SELECT load_no, f, count(*) FILTER (ok) AS load_n FROM ({_EVERY}) y GROUP BY load_no, f),
  c AS (SELECT f, cell, sum(n) AS cell_n, sum(sum(n)) OVER (PARTITION BY f) AS all_n FROM b GROUP BY f, cell),
  g AS (SELECT l.load_no, l.f, load_n, cell_n, all_n, coalesce(b.n, 0) AS n FROM l JOIN c ON c.f = l.f LEFT JOIN b ON b.load_no IS NOT DISTINCT FROM l.load_no AND b.f = c.f AND b.cell = c.cell WHERE load_n > 0),
  h AS (SELECT *, cell_n * load_n / all_n AS want, greatest(n / load_n, 0.0001) AS here, CASE WHEN all_n > load_n THEN greatest((cell_n - n) / (all_n - load_n), 0.0001) ELSE 0.0001 END AS rest FROM g)
  SELECT load_no, f AS field_name, load_n, count(*) FILTER (n > 0) AS cells, round(sum((here - rest) * ln(here / rest)), 6) AS psi, round(sum((n - want) ** 2 / want), 4) AS chi_square FROM h GROUP BY load_no, f, load_n
  UNION ALL SELECT load_no, f, load_n, 0, NULL, NULL FROM l WHERE load_n = 0"""

_BURDEN = """
  SELECT '{table}' AS in_table, {key} AS sample_key, count(*) AS n_rows, sum(cast(coalesce(p, false) AS bigint)) AS n_pass,
    sum(cast(coalesce(contains(e, 'missense_variant'), false) AS bigint)) AS n_missense, sum(cast(coalesce(contains(e, 'synonymous_variant'), false) AS bigint)) AS n_synonymous,
    sum(cast(coalesce(contains(e, 'stop_gained') OR contains(e, 'frameshift') OR contains(e, 'splice_acceptor') OR contains(e, 'splice_donor'), false) AS bigint)) AS n_truncating,
    max(run) AS longest_run
  FROM (SELECT *, CASE WHEN p THEN sum(cast(coalesce(p, false) AS bigint)) OVER (PARTITION BY {key}, grp) ELSE 0 END AS run FROM
    (SELECT *, sum(CASE WHEN coalesce(p, false) THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY row_id) AS grp FROM
      (SELECT {key}, row_id, {effect} AS e, {passes} AS p FROM {table}) a) b) c
  GROUP BY {key}"""

_UNIT = "(\"(?:[^\"]|\"\")*\"|[^\"{s}]*)"


def _cells(feed: str, sep: str) -> str:
    """raw_id, whether the quoting holds, and the fields f (quotes taken off) and t (without surrounding spaces)."""
    unit = _UNIT.format(s=sep)
    return f"""
    SELECT *, list_transform(f, lambda x: trim(x, ' ')) AS t, (SELECT list(term) FROM effect_term WHERE term IS NOT NULL) AS terms FROM (SELECT raw_id, regexp_full_match(l, '{unit}(?:{sep}{unit})*') AS fine,
      list_transform(regexp_extract_all('{sep}' || l, '{sep}{unit}', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS f
      FROM (SELECT raw_id, regexp_replace(coalesce(raw_text, ''), '\\r\\z', '') AS l FROM raw_line WHERE feed = '{feed}') a) b"""


_INTEGER, _DECIMAL = "'[0-9]{1,12}'", "'[+-]?[0-9]+(\\.[0-9]+)?'"


def _number(i: int, low: float, high: float) -> str:
    return f"(t[{i}] = '' OR (regexp_full_match(t[{i}], {_DECIMAL}) AND try_cast(t[{i}] AS double) BETWEEN {low} AND {high}))"


_WHOLE = lambda *at: " AND ".join(f"regexp_full_match(t[{i}], {_INTEGER})" for i in at)
_FEEDS = {
    "mutect2": (
        "\t",
        9,
        f"t[1] <> '' AND t[2] <> '' AND t[9] <> '' AND {_WHOLE(4, 5)} AND try_cast(t[4] AS bigint) >= 1 AND try_cast(t[4] AS bigint) <= try_cast(t[5] AS bigint)"
        " AND regexp_full_match(t[6], '-|[ACGT]+') AND regexp_full_match(t[7], '-|[ACGT]+')"
        " AND len(list_filter(string_split(t[8], ';'), lambda x: NOT list_contains(terms, x))) = 0",
    ),
    "sample_attributes": (",", 6, f"t[1] <> '' AND {_number(2, -1440, 2880)} AND {_number(3, 1, 10)}"),
    "beataml_counts": ("\t", 8, rf"regexp_full_match(t[1], 'ENSG[0-9]{{11}}(\.[0-9]+)?') AND {_WHOLE(5, 6, 7, 8)}"),
}


def _judged(feed: str) -> str:
    sep, n, good = _FEEDS[feed]
    return f"SELECT *, CASE WHEN NOT fine THEN 'quoting' WHEN len(f) <> {n} THEN 'columns' WHEN NOT coalesce({good}, false) THEN 'value' END AS reason FROM ({_cells(feed, sep)}) c"


def _typed(feed: str, columns: str) -> str:
    """``columns``: the fields' names in order; those marked # are whole numbers, ~ decimals."""
    kinds = {"#": "try_cast(nullif(t[{i}], '') AS bigint)", "~": "try_cast(nullif(t[{i}], '') AS double)"}
    cols = [kinds.get(c[0], "f[{i}]").format(i=i) + f' AS "{c.strip("#~")}"' for i, c in enumerate(columns.split(), 1)]
    return f"SELECT raw_id, {', '.join(cols)} FROM ({_judged(feed)}) j WHERE reason IS NULL"


SQL = {
    "p3_sample_burden": _BURDEN.format(table="mutation", key="sample_id", effect="effect", passes="lower(trim(filter_status)) = 'pass'")
    + " UNION ALL "
    + _BURDEN.format(table="beataml_mutation", key="dbgap_sample_id", effect="variant_classification", passes="t_vaf >= 0.05"),
    "p3_found": """
  SELECT 'mutation' AS in_table, sample_id AS sample_key FROM mutation WHERE sample_id IS NOT NULL GROUP BY sample_id HAVING count(*) >= 0.04 * (SELECT count(*) FROM mutation)
  UNION ALL
  SELECT 'beataml_mutation', dbgap_sample_id FROM beataml_mutation WHERE dbgap_sample_id IS NOT NULL GROUP BY dbgap_sample_id HAVING count(*) >= 0.04 * (SELECT count(*) FROM beataml_mutation)""",
    "p4_found": f"SELECT child_table, child_field, row_id FROM ({_ORPHANS}) x",
    "p4_orphans_by_month": f"SELECT child_table, child_field, strftime(loaded_at, '%Y-%m') AS month, count(*) AS orphans FROM ({_ORPHANS}) x GROUP BY 1, 2, 3",
    "p4_pair_orphans": f"""
  SELECT row_id, chr, g1 FROM (SELECT row_id, chr, g1, {GENE.format("g1")} AS k FROM contact) c
  WHERE (chr IS NOT NULL AND k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT chr AS pc, {GENE.format("gene_id")} AS pk FROM gene) p WHERE p.pc = c.chr AND p.pk = c.k))
     OR (chr IS NULL AND k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {GENE.format("gene_id")} AS pk FROM gene) p WHERE p.pk = c.k))
     OR (chr IS NOT NULL AND k IS NULL AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT chr AS pc FROM gene) p WHERE p.pc = c.chr))""",
    "p5_found": f"""
  WITH f AS ({_FIELDS}),
  l AS (SELECT f, load_no, count(*) AS n, count(*) - count(t) AS nulls, median(CASE WHEN ok THEN x END) AS med, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS nv FROM f GROUP BY f, load_no),
  w AS (SELECT f, median(CASE WHEN ok THEN x END) AS wm FROM f GROUP BY f),
  top AS (SELECT f, load_no, max(c) AS tc FROM (SELECT f, load_no, t, count(*) AS c FROM f WHERE ok GROUP BY f, load_no, t) z GROUP BY f, load_no)
  SELECT 'row' AS case_kind, row_id AS key_id, f AS field_name FROM f WHERE t IS NOT NULL AND NOT ok
  UNION ALL
  SELECT 'load', cast(l.load_no AS bigint), l.f FROM l JOIN w ON l.f = w.f LEFT JOIN top ON top.f = l.f AND top.load_no = l.load_no
  WHERE l.nulls >= 0.25 * l.n OR (l.f = 'rin' AND (l.med < 0.7 * w.wm OR l.med > 1.4 * w.wm)) OR (l.f = 'ischaemic' AND (l.med < 0.5 * w.wm OR l.med > 2 * w.wm))
    OR (l.f LIKE 'batch%' AND top.tc > 0.5 * l.nv)""",
    "p5_profile": _PROFILE.format(fields=_FIELDS),
    "p5_profile_columns": _PROFILE.replace("{fields}", _EVERY),
    "p5_drift": _DRIFT,
    "p5_drift_whole": _DRIFT_WHOLE,
    "p6_found": " UNION ALL ".join(f"SELECT raw_id, reason FROM ({_judged(feed)}) j WHERE reason IS NOT NULL" for feed in _FEEDS),
    "p6_mutect2_rows": _typed("mutect2", "sample_id gene chrom #start #end ref alt effect filter"),
    "p6_attribute_rows": _typed("sample_attributes", "sampid ~smtsisch ~smrin smnabtch smgebtch smtsd"),
    "p6_count_rows": _typed("beataml_counts", "stable_id display_label description biotype #count_1 #count_2 #count_3 #count_4"),
}
