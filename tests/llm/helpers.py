"""Small tables, and the SQL check that the driver makes too."""

import os

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def docs_of(spark, rows, schema=DOCS):
    """rows: (doc_id, text[, source])"""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema)


def saved(spark, path, **tables):
    """A folder that reads like a data folder."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    con.execute(sql)
    names = [d[0] for d in con.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in con.fetchall()), key=repr)


#: Texts that try the edges: null, empty, blanks, repeats, other scripts, long words.
EDGE_TEXTS = [None, "", " ", "\n\n", "a", "word " * 40, "ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf", "x" * 5000, "\t\x0b\x0c\r \n", "naïve 中文 🎉 é", "l1 a b c d e\nl1 a b c d e\n\nl3"]
