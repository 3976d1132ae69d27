"""Rows that fail to parse (problem 6): undecoded lines of delimited feeds.

Lines are read in Arrow batches.  A vector pattern finds broken quoting; the CSV reader parses the rest
as strings and hands structurally unfit rows to its invalid-row callback; vector tests then label the
cells whose values are unfit.  Every line carries its own number into the parser as a leading field, so
results never depend on the order in which rows come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTEGER = r"^[0-9]{1,12}$"
DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?$"


@dataclass(frozen=True)
class Cell:
    """One field of a feed.  ``pattern``: what its text must match, surrounding spaces removed;
    ``optional``: an empty text passes; ``low``/``high``: range of the number; ``terms``: the permitted
    members of a ``;`` list."""

    name: str
    kind: str = "string"
    pattern: str | None = None
    optional: bool = False
    low: float | None = None
    high: float | None = None
    terms: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Feed:
    name: str
    separator: str
    cells: tuple[Cell, ...]
    ordered: tuple[tuple[str, str], ...] = field(default=())  #: pairs of integer fields, the first not above the second

    def quoting(self) -> str:
        sep = {"\t": r"\t", ",": ",", ";": ";", "|": r"\|"}[self.separator]
        one = rf'(?:"(?:[^"]|"")*"|[^"{sep}][^"{sep}]*|)'
        return rf"\A{one}(?:{sep}{one})*\z"


def _fits(cell: Cell, text: pa.Array) -> pa.Array:
    if not len(text):
        return pa.array([], pa.bool_())
    good = pc.match_substring_regex(text, cell.pattern) if cell.pattern else pc.greater_equal(pc.utf8_length(text), 0)
    if cell.terms is not None:
        parts = pc.split_pattern(text, ";")
        flat = pc.is_in(parts.flatten(), value_set=pa.array(cell.terms, pa.string()))
        owner = pc.list_parent_indices(parts)
        bad = pc.unique(owner.filter(pc.invert(flat)))
        good = pc.and_(good, pc.invert(pc.is_in(pa.array(range(len(text)), owner.type), value_set=bad)))
    if cell.low is not None or cell.high is not None:
        number = pc.cast(pc.replace_substring_regex(pc.if_else(good, text, pa.scalar("0")), r"^\+", ""), pa.float64())
        inside = pc.and_(pc.greater_equal(number, cell.low if cell.low is not None else float("-inf")), pc.less_equal(number, cell.high if cell.high is not None else float("inf")))
        good = pc.and_(good, inside)
    if cell.optional:
        good = pc.or_(good, pc.equal(text, ""))
    return good


def _stand_ins(texts: pa.Array, wanted: list[str]) -> dict[str, str]:
    """For each of the ``wanted`` characters that occurs in ``texts`` another one that does not."""
    there = [c for c in wanted if pc.any(pc.match_substring(texts, c)).as_py()]
    free = (chr(c) for c in (*range(0xE000, 0xF900), *range(0xF0000, 0x10FFFE)) if not pc.any(pc.match_substring(texts, chr(c))).as_py())
    return dict(zip(there, free))


def parse_batch(feed: Feed, texts: pa.Array) -> tuple[list[str | None], list[str | None], list[list[str] | None]]:
    """(reason, unfit cells, fields) of each line; reason None for a valid one.  A null line counts as an
    empty one, and a final carriage return is no part of a line.  All other characters, line breaks too, are
    data and come out as they are."""
    n, sep = len(texts), feed.separator
    texts = pc.fill_null(texts, "")
    texts = pc.replace_substring_regex(texts, r"\r\z", "")
    fine = pc.match_substring_regex(texts, feed.quoting())
    reason: list[str | None] = [None if x else "quoting" for x in fine.to_pylist()]
    labels: list[str | None] = [None] * n
    fields: list[list[str] | None] = [None] * n
    numbers = pa.array(range(n), pa.int64())
    # line breaks inside a line are data here; the parser must not see them
    hidden, safe = _stand_ins(texts, ["\n", "\r", "\0"]), texts
    for c, other in hidden.items():
        safe = pc.replace_substring(safe, c, other)
    lines = pc.binary_join_element_wise(pc.cast(numbers, pa.string()), safe, sep).filter(fine)
    if not len(lines):
        return reason, labels, fields
    body = ("\n".join(lines.to_pylist()) + "\n").encode()
    names = ["_no", *[c.name for c in feed.cells]]

    def reject(row: csv.InvalidRow) -> str:
        reason[int(row.text.split(sep, 1)[0].strip())] = "columns"
        return "skip"

    read = csv.read_csv(
        pa.BufferReader(body),
        read_options=csv.ReadOptions(use_threads=False, block_size=len(body) + 16, column_names=names),
        parse_options=csv.ParseOptions(delimiter=sep, quote_char='"', double_quote=True, escape_char=False, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=reject),
        convert_options=csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, check_utf8=False),
    ).combine_chunks()
    at = [int(x) for x in read.column("_no").to_pylist()]
    if not at:
        return reason, labels, fields
    text = {c.name: pc.utf8_trim(read.column(c.name).combine_chunks(), " ") for c in feed.cells}
    good = {c.name: _fits(c, text[c.name]).to_pylist() for c in feed.cells if c.pattern or c.terms or c.low is not None}
    whole = {c.name: pc.if_else(pa.array(good[c.name]), text[c.name], pa.scalar("0")).to_pylist() for c in feed.cells if any(c.name in pair for pair in feed.ordered)}
    columns = []
    for c in feed.cells:
        column = read.column(c.name).combine_chunks()
        for own, other in hidden.items():
            column = pc.replace_substring(column, other, own)
        columns.append(column.to_pylist())
    for k, i in enumerate(at):
        bad = [name for name, ok in good.items() if not ok[k]]
        for a, b in feed.ordered:
            if good[a][k] and good[b][k] and int(whole[a][k]) > int(whole[b][k]):
                bad += [x for x in (a, b) if x not in bad]
        fields[i] = [col[k] for col in columns]
        if bad:
            reason[i], labels[i] = "value", ",".join(bad)
    return reason, labels, fields


def parse_lines(df: DataFrame, feeds: list[Feed], row_id: str = "raw_id", feed: str = "feed", text: str = "raw_text") -> DataFrame:
    """(row id, feed, reason, unfit cells, fields) of every line, in one pass without a shuffle.  Lines of
    a feed that is not described, or of none, have the reason ``feed``.  Repeated lines are judged each;
    an empty table gives an empty one."""
    known = {f.name: f for f in feeds}
    out = pa.schema([("row_id", pa.int64()), ("feed", pa.string()), ("reason", pa.string()), ("unfit", pa.string()), ("fields", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, texts = batch.column(0), batch.column(1), batch.column(2)
            for name in pc.unique(names).to_pylist():
                mine = pc.is_null(names) if name is None else pc.fill_null(pc.equal(names, name), False)
                part, lines = ids.filter(mine), texts.filter(mine)
                if name in known:
                    reason, labels, fields = parse_batch(known[name], lines)
                else:
                    reason, labels, fields = ["feed"] * len(part), [None] * len(part), [None] * len(part)
                yield pa.RecordBatch.from_arrays([part.cast(pa.int64()), pa.array([name] * len(part), pa.string()), pa.array(reason, pa.string()), pa.array(labels, pa.string()), pa.array(fields, pa.list_(pa.string()))], schema=out)

    parsed = df.select(F.col(row_id).cast("bigint"), F.col(feed).cast("string"), F.col(text).cast("string")).mapInArrow(run, "row_id bigint, feed string, reason string, unfit string, fields array<string>")
    return parsed.withColumnRenamed("row_id", row_id)


def typed_rows(parsed: DataFrame, feed: Feed, row_id: str = "raw_id") -> DataFrame:
    """The valid lines of one feed as typed columns; an empty optional number is null."""
    kinds = {"string": "string", "integer": "bigint", "decimal": "double"}
    cols = []
    for i, c in enumerate(feed.cells):
        value = F.element_at("fields", i + 1)
        cols.append((value if c.kind == "string" else F.nullif(F.trim(value), F.lit("")).cast(kinds[c.kind])).alias(c.name))
    return parsed.where((F.col("feed") == feed.name) & F.col("reason").isNull()).select(row_id, *cols)


def feeds_of_project(effects: list[str]) -> list[Feed]:
    """The three feeds of ``raw_line``; ``effects`` are the permitted effect terms."""
    full = r"."
    count = dict(kind="integer", pattern=INTEGER)
    mutect = Feed(
        "mutect2",
        "\t",
        (
            Cell("sample_id", pattern=full),
            Cell("gene", pattern=full),
            Cell("chrom"),
            Cell("start", low=1, **count),
            Cell("end", **count),
            Cell("ref", pattern=r"^(?:-|[ACGT]+)$"),
            Cell("alt", pattern=r"^(?:-|[ACGT]+)$"),
            Cell("effect", terms=tuple(effects)),
            Cell("filter", pattern=full),
        ),
        ordered=(("start", "end"),),
    )
    attributes = Feed(
        "sample_attributes",
        ",",
        (
            Cell("sampid", pattern=full),
            Cell("smtsisch", kind="decimal", pattern=DECIMAL, optional=True, low=-1440, high=2880),
            Cell("smrin", kind="decimal", pattern=DECIMAL, optional=True, low=1, high=10),
            Cell("smnabtch"),
            Cell("smgebtch"),
            Cell("smtsd"),
        ),
    )
    counts = Feed(
        "beataml_counts",
        "\t",
        (
            Cell("stable_id", pattern=r"^ENSG[0-9]{11}(?:\.[0-9]+)?$"),
            Cell("display_label"),
            Cell("description"),
            Cell("biotype"),
            *[Cell(f"count_{i}", **count) for i in range(1, 5)],
        ),
    )
    return [mutect, attributes, counts]
