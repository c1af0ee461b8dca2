"""Small documents with the cases every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch en ei ich ung der ver zu ß ä".split(), "fr": "eau oi ê ç ou ment que le è tion".split()}
NOTICE = "Released under the MIT License."


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def make_rows(n=90, seed=3):
    rng = random.Random(seed)
    shared = [f"shared line number {i} of every page here" for i in range(4)]
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = "\n".join(words(rng, lang, rng.randint(3, 30)).capitalize() + "." for _ in range(rng.randint(1, 6)))
        if i % 4 == 0:
            text += "\n" + rng.choice(shared)
        if i % 10 == 3:
            text += "\n" + NOTICE
        if i % 9 == 5:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, lang, f"src{rng.choice([0, 0, 0, 1, 2, 3])}", len(text)))
    base = rows[7][1]
    rows += [(n + k, base, "en", "src0", len(base)) for k in range(6)]  # exact copies
    rows += [(n + 10 + k, base + f" tail{k}", "en", "src1", 0) for k in range(4)]  # near copies
    long = "\n".join(words(rng, "de", 400) for _ in range(30))
    rows += [
        (n + 20, None, None, None, None),
        (n + 21, "", "en", "src2", 0),
        (n + 22, "  \t \n\n", None, "src0", 4),
        (n + 23, long, "de", "src0", len(long)),
        (n + 24, "12345 !!! ???", None, None, 13),
        (n + 25, "É ß ΑΣ <|endoftext|> x\x1cy\r\nİ ﬁ é 日本語 😀", "fr", "srcé", 30),
        (n + 26, "short", "en", "", 5),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 0 if r[1] and "!!" in r[1] else 1, 0) for r in rows if r[0] % 5 != 4] + [(10_000, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns named like results and like the operators' own."""
    from pyspark.sql import functions as F

    names = "id score predicted held_out lang_pred fp rep fingerprint component_id size key cut taken target source_size n_lines n_dropped drops piece start length media license begin end label words pos h1 h2 node component sequence_id offset kept_id row rows node c0 c1 hashes tile t u".split()
    return docs.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def table_dir(spark, docs, labels, tmp_path_factory):
    """The tables as the queries read them."""
    d = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, [float((i * 7 + j * j) % 11 - 5) / 7 for j in range(6)], i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, "http://adult-x.example.com/en/1"), (2, "https://a.org/x"), (3, None)], "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    return str(d)
