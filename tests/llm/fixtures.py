"""Small tables with the odd cases: nulls, empty and long texts, ties, copies, clashing columns."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and to in is it was for on with as at by an be this from or are".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    for k in range(words):
        word = rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(3, 9)))
        out.append(word.capitalize() + "" if k % 11 == 0 else word + "." * (k % 11 == 10))
    return " ".join(out)


def odd_texts() -> list[str | None]:
    long = prose(1, 4000)
    base = prose(2, 200)
    near = base.split()
    near[50] = "changed"
    return [
        None, "", " \t\n", "one", "Two words", "a b c d e", "A B C D E", base, base, " ".join(near), base.upper(), long, long + " end",
        "same line here\n" * 30, "x " * 500, "é ß 日本語 🙂 \x1c   z", prose(3, 300), prose(4, 30) + "\n" + prose(4, 30) + "\n" + prose(5, 10), "# | < > $ % & *", None, "",
        "mail a.b@c-d.example.com and +x@y.z 1.2.3.4 999.1.1.1 4111 1111 1111 1111 call +1 (212) 555-0100 now", "aa@b.cd+e@f.gh 10.0.0.1.2.3.4.5 +1+2+33 (44) 555 666 777",
    ]


def documents(spark, texts=None, extra=False):
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(odd_texts() if texts is None else texts)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    if extra:  # names that operators might use themselves
        for name in ("digest", "keep_id", "group_size", "n_words", "kept", "shard", "rep", "component_id", "start", "length", "__text", "__id", "__gone", "body", "row", "mark", "version", "spans", "own", "id"):
            df = df.selectExpr("*", f"doc_id AS {name}")
    return df


def folder(df, tmp_path, name="documents"):
    df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
