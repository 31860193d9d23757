"""Per-file profiles of delimited exports: encoding, delimiter, header, columns, number format.

A *lines* frame has one row per physical line: ``file``, ``block`` (a bounded stretch of the
file), ``pos`` (order inside the block) and ``value`` (the bytes as read). Nothing below groups
a whole file: full scans aggregate by (file, block) with partial aggregation, and only the
lines of the blocks that hold a file's first two rows are brought together.

Delimiter and number format are voted by all lines of a file. ``sample=True`` decides them as
spreadsheet importers do, from the file's first characters and its first data row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ghgspark.constants import (
    DEFAULT_DELIMITER,
    DELIMITER_SAMPLE_CHARS,
    DELIMITER_SAMPLE_LINES,
    DELIMITERS,
    ENERGY_CELL_VALUES,
    EXPORT_HEADER_WORDS,
    EXTRA_HEADER_WORDS,
    MIN_HEADER_CELLS,
    MIN_INFERRED_FIELDS,
    PERIOD_CELL_PATTERN,
    UNIT_CELL_VALUES,
)
from ghgspark.functions import header_key, locale_number, number_format_of, number_vote, strip
from ghgspark.functions.numbers import ENGLISH, GERMAN

UTF8, CP1252, LATIN1 = "utf-8-sig", "cp1252", "iso-8859-1"
FIELDS = tuple(EXPORT_HEADER_WORDS)


def _cp1252_table() -> tuple[str, str, str]:
    """C1 code points, what cp1252 makes of them, and the five it leaves undefined."""
    source, target, undefined = "", "", ""
    for code in range(0x80, 0xA0):
        try:
            target += bytes([code]).decode("cp1252")
            source += chr(code)
        except UnicodeDecodeError:
            undefined += chr(code)
    return source, target, undefined


_C1, _C1_AS_CP1252, _UNDEFINED = _cp1252_table()


def _latin1(value: Column) -> Column:
    return F.decode(value.cast("binary"), "ISO-8859-1")


def _cp1252(value: Column) -> Column:
    return F.translate(_latin1(value), _C1, _C1_AS_CP1252)


def decode_line(value: Column, encoding: Column) -> Column:
    """Text of a raw line in its file's encoding."""
    return (
        F.when(encoding == UTF8, value)
        .when(encoding == CP1252, _cp1252(value))
        .otherwise(_latin1(value))
    )


def _split_quoted(text: Column, delimiter: str) -> Column:
    # A field runs from a delimiter to the next one; inside an opening quote it runs to the
    # closing quote first. The text gets a leading delimiter so that every field starts with one.
    d = "\\t" if delimiter == "\t" else delimiter
    field = rf'{d}("(?:[^"]|"")*(?:"[^{d}]*|$)|[^{d}]*)'
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), text), F.lit(field), F.lit(1))

    def unquote(cell: Column) -> Column:
        inner = F.regexp_extract(cell, r'^"((?:[^"]|"")*)"?(.*)$', 1)
        rest = F.regexp_extract(cell, r'^"((?:[^"]|"")*)"?(.*)$', 2)
        return F.when(
            F.startswith(cell, F.lit('"')),
            F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest),
        ).otherwise(cell)

    return F.transform(found, unquote)


def split_cells(text: Column, delimiter: Column) -> Column:
    """Cells of a line, trailing empty ones kept; double quotes group, doubled quotes escape."""
    quoted = F.contains(text, F.lit('"'))
    cases = F
    for d in DELIMITERS:
        cases = cases.when((delimiter == d) & ~quoted, F.split(text, "\\t" if d == "\t" else d))
        cases = cases.when(delimiter == d, _split_quoted(text, d))
    return cases


def has_cell_text(value: Column, delimiter: str) -> Column:
    """True unless every cell of the raw line is blank under ``delimiter``."""
    text = F.when(F.is_valid_utf8(value), value).otherwise(_cp1252(value))
    d = "\\t" if delimiter == "\t" else delimiter
    return F.when(
        F.contains(text, F.lit('"')),
        F.exists(_split_quoted(text, delimiter), lambda c: strip(c) != ""),
    ).otherwise(text.rlike(rf"(?U)[^\s{d}]"))


def _rows_column(delimiter: str) -> str:
    return f"rows_{DELIMITERS.index(delimiter)}"


def _most_frequent(text: Column) -> Column:
    """The delimiter that a line has most of (ties go to the earlier one), null without any."""
    counts = {d: F.char_length(text) - F.char_length(F.replace(text, F.lit(d), F.lit(""))) for d in DELIMITERS}
    best = F.greatest(*counts.values())
    pick = F
    for d, count in counts.items():
        pick = pick.when((count == best) & (best > 0), d)
    return pick


def _vote_columns() -> list[str]:
    return [f"{what}_{n}" for n in range(len(DELIMITERS)) for what in ("votes", GERMAN, ENGLISH)]


def block_profile(lines: DataFrame) -> DataFrame:
    """One row per (file, block): encoding evidence, length, rows under each delimiter, votes of the lines."""
    value = F.col("value")
    valid = F.is_valid_utf8(value)
    undefined = F.when(value.rlike(r"[^\x00-\x7f]"), _latin1(value).rlike(f"[{_UNDEFINED}]"))
    text = F.when(valid, value).otherwise(_cp1252(value))
    voted = lines.withColumn("_text", text).withColumn("_delimiter", _most_frequent(F.col("_text"))).withColumn(
        "_format", number_vote(split_cells(F.col("_text"), F.col("_delimiter"))))
    votes = [
        x for n, d in enumerate(DELIMITERS) for x in (
            F.count_if(F.col("_delimiter") == d).alias(f"votes_{n}"),
            *[F.count_if((F.col("_delimiter") == d) & (F.col("_format") == kind)).alias(f"{kind}_{n}")
              for kind in (GERMAN, ENGLISH)])
    ]
    return voted.groupBy("file", "block").agg(
        *votes,
        F.bool_and(valid).alias("utf8"),
        F.bool_or(F.coalesce(undefined, F.lit(False))).alias("undefined"),
        F.sum(F.char_length("_text") + 1).alias("chars"),
        *[F.count_if(has_cell_text(value, d)).alias(_rows_column(d)) for d in DELIMITERS],
    )


def _encoding(utf8: Column, undefined: Column) -> Column:
    return F.when(utf8, UTF8).when(~undefined, CP1252).otherwise(LATIN1)


def file_encoding(lines: DataFrame) -> DataFrame:
    """``file, encoding``: UTF-8 if every line is valid, else cp1252, else ISO 8859-1."""
    return (
        block_profile(lines)
        .groupBy("file")
        .agg(_encoding(F.bool_and("utf8"), F.bool_or("undefined")).alias("encoding"))
    )


def _voted(total) -> tuple[Column, Column]:
    """Delimiter and number format of a file; ``total`` adds a vote column up over its blocks."""
    votes = [total(f"votes_{n}") for n in range(len(DELIMITERS))]
    best = F.greatest(*votes)
    delimiter, fmt = F.when(best == 0, DEFAULT_DELIMITER), F.when(best == 0, GERMAN)
    for n, d in enumerate(DELIMITERS):
        delimiter = delimiter.when(votes[n] == best, d)
        fmt = fmt.when((votes[n] == best) & (total(f"{ENGLISH}_{n}") > total(f"{GERMAN}_{n}")), ENGLISH).when(
            votes[n] == best, GERMAN)
    return delimiter, fmt


def _head_blocks(blocks: DataFrame, sample: bool) -> DataFrame:
    """The blocks that hold a file's first two rows (and, with ``sample``, its delimiter sample)."""
    whole = W.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    rows = F.least(*[F.col(_rows_column(d)) for d in DELIMITERS])
    delimiter, fmt = _voted(lambda name: F.sum(name).over(whole))
    sampled = F.col("chars_before") < DELIMITER_SAMPLE_CHARS if sample else F.lit(False)
    return (
        blocks.select(
            "file",
            "block",
            delimiter.alias("voted_delimiter"),
            fmt.alias("voted_format"),
            _encoding(F.bool_and("utf8").over(whole), F.bool_or("undefined").over(whole)).alias("encoding"),
            F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
            F.coalesce(F.sum(rows).over(before), F.lit(0)).alias("rows_before"),
        )
        .where(sampled | (F.col("rows_before") < 2))
        .select("file", "block", "encoding", "voted_delimiter", "voted_format")
    )


def _pick_delimiter(lowest: dict[str, Column]) -> Column:
    best = F.greatest(*lowest.values())
    pick = F.when(F.coalesce(best, F.lit(0)) == 0, DEFAULT_DELIMITER)
    for d, count in lowest.items():
        pick = pick.when(count == best, d)
    return pick


def _sampled_delimiter(text: DataFrame, upto, before, whole) -> DataFrame:
    """Add ``delimiter`` as the first lines within the sample tell it."""
    start = F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0))
    room = F.greatest(F.lit(DELIMITER_SAMPLE_CHARS) - start, F.lit(0)).cast("int")
    sampled = text.withColumn("sample", F.substr("text", F.lit(1), room))
    filled = F.when(strip(F.col("sample")) != "", 1).otherwise(0)
    sampled = sampled.withColumn("sample_no", F.when(filled == 1, F.sum(filled).over(upto)))

    in_sample = F.col("sample_no") <= DELIMITER_SAMPLE_LINES
    lowest = {
        d: F.min(
            F.when(in_sample, F.char_length("sample") - F.char_length(F.replace("sample", F.lit(d), F.lit(""))))
        ).over(whole)
        for d in DELIMITERS
    }
    return sampled.withColumn("delimiter", _pick_delimiter(lowest))


def head_rows(lines: DataFrame, blocks: DataFrame, sample: bool = False) -> DataFrame:
    """``file, encoding, delimiter, voted_format, row1, row2``: the first two non-blank rows of each file."""
    heads = _head_blocks(blocks, sample)
    whole = W.partitionBy("file")
    ordered = whole.orderBy("block", "pos")
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)

    # The scalar bound drops all other blocks in the scan, so the join sees head lines only.
    last_head = heads.agg(F.max("block").alias("last")).scalar()
    text = lines.where(F.col("block") <= last_head).join(heads, ["file", "block"]).select(
        "file", "block", "pos", "value", "encoding", "voted_delimiter", "voted_format", decode_line(F.col("value"), F.col("encoding")).alias("text")
    )
    if sample:
        delimited = _sampled_delimiter(text, upto, before, whole)
    else:
        delimited = text.withColumn("delimiter", F.col("voted_delimiter"))
    is_row = reduce(
        lambda case, d: case.when(F.col("delimiter") == d, has_cell_text(F.col("value"), d)), DELIMITERS, F
    )
    row_no = F.sum(F.when(is_row, 1).otherwise(0)).over(upto)
    return (
        delimited.withColumn("is_row", is_row)
        .withColumn("row_no", row_no)
        .withColumn("cells", F.when(F.col("is_row") & (F.col("row_no") <= 2), split_cells(F.col("text"), F.col("delimiter"))))
        .groupBy("file", "encoding", "delimiter", "voted_format")
        .agg(*[F.max(F.when(F.col("row_no") == n, F.col("cells"))).alias(f"row{n}") for n in (1, 2)])
    )


def is_header(cells: Column) -> Column:
    """At least three cells are known header words."""
    words = [w for group in EXPORT_HEADER_WORDS.values() for w in group] + list(EXTRA_HEADER_WORDS)
    return F.size(F.filter(cells, lambda c: header_key(c).isin(words))) >= MIN_HEADER_CELLS


def header_columns(cells: Column) -> dict[str, Column]:
    """Zero-based column of each field by header word, null where there is none."""
    keys = F.transform(cells, header_key)
    return {
        field: F.nullif(F.array_position(F.transform(keys, lambda k: k.isin(*words)), F.lit(True)), F.lit(0)) - 1
        for field, words in EXPORT_HEADER_WORDS.items()
    }


def _first_index(cells: Column, taken: list[Column], accept) -> Column:
    """Lowest free index whose trimmed cell is accepted."""

    def free(i: Column) -> Column:
        ok = accept(strip(F.get(cells, i)))
        for other in taken:
            ok = ok & (F.coalesce(other, F.lit(-1)) != i)
        return ok

    index = F.sequence(F.lit(0), F.size(cells) - 1)
    return F.get(F.filter(index, free), 0)


def inferred_columns(row: DataFrame) -> DataFrame:
    """Columns of headerless files from their first row (``row1``), in strict priority order.

    Each step is a column of its own so that later steps refer to it instead of repeating it.
    """
    cells = F.col("row1")
    known = UNIT_CELL_VALUES + ENERGY_CELL_VALUES
    rules = (
        ("unit", lambda c: F.lower(c).isin(*UNIT_CELL_VALUES)),
        ("energy_type", lambda c: F.lower(c).isin(*ENERGY_CELL_VALUES)),
        ("period", lambda c: c.rlike(PERIOD_CELL_PATTERN)),
        ("site", lambda c: (c != "") & ~c.rlike(r"^[\d.,\s]+$") & ~F.lower(c).isin(*known)),
    )
    taken: list[Column] = []
    for field, accept in rules:
        row = row.withColumn(f"inferred_{field}", _first_index(cells, taken, accept))
        taken.append(F.col(f"inferred_{field}"))

    def size_of(i: Column) -> Column:
        amount = locale_number(F.get(cells, i), "german")
        for other in taken:
            amount = F.when(F.coalesce(other, F.lit(-1)) != i, amount)
        return F.struct((-F.abs(amount)).alias("rank"), i.alias("i"))

    ranked = F.sort_array(
        F.filter(
            F.transform(F.sequence(F.lit(0), F.size(cells) - 1), size_of),
            lambda s: s["rank"].isNotNull(),
        )
    )
    row = row.withColumn("ranked", ranked)
    for n, field in enumerate(("energy_amount", "total_eur")):
        row = row.withColumn(f"inferred_{field}", F.get(F.col("ranked"), n)["i"])
    return row.drop("ranked")


_INFERABLE = ("unit", "energy_type", "period", "site", "energy_amount", "total_eur")


def file_profile(lines: DataFrame, blocks: DataFrame | None = None, sample: bool = False) -> DataFrame:
    """One row per file that has any row: how to read it, or why it cannot be read.

    Columns: ``file, encoding, delimiter, has_header, number_format, columns (struct of
    zero-based indexes), min_cells, error``.
    """
    blocks = block_profile(lines) if blocks is None else blocks
    rows = head_rows(lines, blocks, sample).where(F.col("row1").isNotNull())
    rows = inferred_columns(rows.withColumn("has_header", is_header(F.col("row1"))))
    header = header_columns(F.col("row1"))
    columns = {
        field: F.when(F.col("has_header"), header[field].cast("int")).otherwise(
            F.col(f"inferred_{field}") if field in _INFERABLE else F.lit(None).cast("int")
        )
        for field in FIELDS
    }
    found = F.size(F.array_compact(F.array(*[F.col(f"inferred_{f}") for f in _INFERABLE])))
    first_data = F.when(F.col("has_header"), F.col("row2")).otherwise(F.col("row1"))
    return rows.select(
        "file",
        "encoding",
        "delimiter",
        "has_header",
        (number_format_of(F.coalesce(first_data, F.array().cast("array<string>"))) if sample
         else F.col("voted_format")).alias("number_format"),
        F.struct(*[c.alias(f) for f, c in columns.items()]).alias("columns"),
        F.when(
            ~F.col("has_header") & (found < MIN_INFERRED_FIELDS),
            F.concat(
                F.lit("Cannot infer column mapping for "), F.col("file"),
                F.lit(f" (fewer than {MIN_INFERRED_FIELDS} columns identifiable)"),
            ),
        ).alias("error"),
    ).withColumn("min_cells", F.greatest(*[F.col(f"columns.{f}") for f in FIELDS]) + 1)


def block_offsets(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """File profile repeated per block, with the number of rows in the file's earlier blocks."""
    rows = reduce(
        lambda case, d: case.when(F.col("delimiter") == d, F.col(_rows_column(d))), DELIMITERS, F
    )
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return (
        blocks.join(files, "file")
        .withColumn("rows_before", F.coalesce(F.sum(rows).over(before), F.lit(0)))
        .drop("utf8", "undefined", "chars", *_vote_columns(), *[_rows_column(d) for d in DELIMITERS])
    )
