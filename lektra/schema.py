"""Table schemas, and the check of a candidate database against them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import types as T

# Columns of the corpus database; "!" marks what must not be null, "*" the key.
TABLES = {
    "authors": "id string*!, name string!, name_alt string, language string!, has_translations int",
    "works": "id string*!, author_id string!, title string!, title_alt string, title_english string, type string, urn string, description string",
    "books": "id string*!, work_id string!, book_number int!, label string, start_line int, end_line int, line_count int",
    "text_lines": "id long*!, book_id string!, line_number int!, line_text string!, line_xml string, speaker string",
    "words": "id long*!, word string!, word_normalized string!, book_id string!, line_number int!, word_position int!",
    "word_forms": "word string, word_normalized string, book_id string*, line_number int*, word_position int*, char_start int, char_end int",
    "translation_segments": "id long*!, book_id string!, start_line int!, end_line int, translation_text string!, translator string, speaker string",
    "translation_lookup": "book_id string*!, line_number int*!, segment_id long*!",
    "dictionary_entries": "id long*!, headword string!, headword_normalized string!, language string!, entry_xml string, entry_html string, entry_plain string, source string",
    "lemma_map": "word_form string*!, word_normalized string!, lemma string*!, confidence double, source string, morph_info string",
    "bookmarks": "id long*!, work_id string, book_id string, line_number int, author_name string, work_title string, book_label string, line_text string, note string, created_at long, last_accessed long",
}
_FAMILIES = (
    {"string", "varchar", "char"},
    {"tinyint", "smallint", "int", "bigint"},
    {"float", "double"},
)


def struct(name: str) -> T.StructType:
    fields = []
    for col in TABLES[name].split(", "):
        field, kind = col.split(" ")
        fields.append(T.StructField(field, _TYPES[kind.strip("*!")], "!" not in kind))
    return T.StructType(fields)


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}


def keys(name: str) -> list[str]:
    return [c.split(" ")[0] for c in TABLES[name].split(", ") if "*" in c]


def compatible(actual: T.DataType, expected: T.DataType) -> bool:
    """Same type, or of one family (texts, whole numbers, fractions)."""
    a, e = actual.simpleString(), expected.simpleString()
    a, e = a.split("(")[0], e.split("(")[0]
    return a == e or any(a in f and e in f for f in _FAMILIES)


def validate(
    candidate: Mapping[str, T.StructType], expected: Mapping[str, T.StructType] | None = None,
    nullability: bool = False,
) -> list[str]:
    """What is wrong with a candidate: missing tables and columns, types that do not
    fit, and, if asked for, nullability. Extra tables and columns are accepted."""
    expected = expected or {t: struct(t) for t in TABLES}
    issues = []
    for table, want in expected.items():
        if table not in candidate:
            issues.append(f"missing table: {table}")
            continue
        have = {f.name: f for f in candidate[table].fields}
        for f in want.fields:
            got = have.get(f.name)
            if got is None:
                issues.append(f"missing column: {table}.{f.name}")
            elif not compatible(got.dataType, f.dataType):
                issues.append(f"type of {table}.{f.name}: {got.dataType.simpleString()}, not {f.dataType.simpleString()}")
            elif nullability and got.nullable != f.nullable:
                issues.append(f"nullability of {table}.{f.name}")
    return issues
