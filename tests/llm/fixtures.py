"""Small inputs with every odd case, and reference results in plain Python."""

from __future__ import annotations

#: nulls, empty and blank texts, one word, copies under several ids, shared lines, spans, a repeated row.
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog again and again\nshared line one two\nonly here", "en", "a", 5),
    (1, "The quick brown fox jumps over the lazy dog again and again\nshared line one two\nonly here", "en", "a", 5),
    (2, None, "en", "b", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "fr", "", 4),
    (5, "word", "fr", "b", 4),
    (6, "  SHARED line One two \r\nMail bob.smith@mail.example.com or +1 (017) 555-7713, ip 10.0.0.255 and 10.0.0.256.", "de", "b", 1),
    (7, "card 4539 1488 0343 6467 and 4539 1488 0343 6468; é ü 𝔘 +12 a@b.c_x@d.e", "es", "c", 1),
    (9, "x " * 3000 + "end", "en", "a", 1),
    (9, "x " * 3000 + "end", "en", "a", 1),
    (None, "shared line one two\n\nno id here", None, None, None),
    (120, "1.2.3.4.5.6.7.8 0000001.2.3.4 5 - 6 +1((((2)))) +99999999999", "en", "d", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(TEXTS if rows is None else rows, COLUMNS)


def written(spark, path, rows=None) -> str:
    """The rows as a folder of tables that queries can read."""
    frame(spark, rows).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
