"""License scans by diagonal voting, in DataFrame functions only.

All rolling word pairs of a text are hashed, and pairs and 4-grams at the places where a template's pair stands are
joined, by hash and then by their words, to the places that they have in the templates.  A hit votes for its diagonal,
the place in the text less the place in the template.  Diagonals that lie up to NEAR words apart (words too many or too
few) are merged around each of them, and the span is verified: only distinct places of the template in ascending order
count, so a word pair that is repeated in the text counts once.  A base phrase stands where one diagonal has all its
pairs.

Names of licenses are templates of word pairs: a span must hold the first and the last pair and all others, but for one
where a name has five pairs or more.  Texts of licenses are templates of 4-grams, of which a span must hold three in four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Names of public licenses and their labels.
NAMES = (
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license v2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu general public license v3", "gpl-3.0"),
    ("gnu gpl", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license version 2 0", "apache-2.0"),
    ("apache license 2 0", "apache-2.0"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd 2 clause license", "bsd-2-clause"),
    ("bsd 3 clause license", "bsd-3-clause"),
    ("isc license", "isc"),
    ("cc by 4 0", "cc-by-4.0"),
    ("cc by nc 4 0", "cc-by-nc-4.0"),
    ("cc by sa 4 0", "cc-by-sa-4.0"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
)
#: Texts of public licenses, or what stands in them and in the notices that refer to them, and their labels.
TEXTS = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and "
        "or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations "
        "under the license",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "gpl",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "mpl",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Words of a gram in names and in texts; diagonals this far from one another are merged; places of a name from which on
#: one may be missing; percent of a text's places that a span must hold.
PAIR, GRAM = 2, 4
NEAR = 2
SPARE_FROM = 5
TEXT_PERCENT = 75

_NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def templates() -> list[tuple[str, list[str], int, str]]:
    """(kind, words, words a gram, label): base, name or text."""
    out = []
    for kind, own, k in (("base", BASE, PAIR), ("name", NAMES, PAIR), ("text", TEXTS, GRAM)):
        out += [(kind, phrase.split(), k, label) for phrase, label in own]
    return out


def template_places(spark: SparkSession) -> DataFrame:
    """(gram, hash, t, place, places, kind, label): a fixed number of rows; template -1 marks the row of the text itself."""
    rows = [("", -1, 0, 0, "", "")]
    for t, (kind, words, k, label) in enumerate(templates()):
        n = len(words) - k + 1
        rows += [(" ".join(words[i : i + k]), t, i, n, kind, label) for i in range(n)]
    values = ", ".join(f"('{g}', {t}, {i}, {n}, '{kind}', '{label}')" for g, t, i, n, kind, label in rows)
    return spark.sql(f"SELECT gram, xxhash64(gram) AS hash, t, place, places, kind, label FROM VALUES {values} AS v(gram, t, place, places, kind, label)")


def pair_hashes(spark: SparkSession) -> list[int]:
    """Hashes of the pairs with which grams of the templates begin: some hundreds."""
    pairs = sorted({(words[i], words[i + 1]) for _, words, k, _ in templates() for i in range(len(words) - k + 1)})
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return [r.h for r in spark.sql(f"SELECT xxhash64(a, b) AS h FROM VALUES {values} AS v(a, b)").collect()]


def grams(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, key, size, n_words, at, gram: grams at places where a template's pair stands, and one empty gram a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # lower() also maps letters beyond ASCII, but to word characters, and the Kelvin sign (to k) is in no base phrase
    parts = F.split(F.lower(text), _NO_WORD, -1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.length(text).alias("size"), parts.alias("p"))
    before = F.when(F.col("p")[0] == "", 1).otherwise(0)
    after = F.when((F.size("p") > 1) & (F.element_at("p", -1) == ""), 1).otherwise(0)
    rows = rows.withColumn("w", F.slice("p", before + 1, F.size("p") - before - after)).withColumn("n", F.size("w"))
    known = pair_hashes(spark)
    word = lambda i: F.get(F.col("w"), i)
    places = F.when(F.col("n") >= PAIR, F.filter(F.sequence(F.lit(0), F.col("n") - PAIR), lambda i: F.xxhash64(word(i), word(i + 1)).isin(known))).otherwise(F.array().cast("array<int>"))
    gram = lambda i, k: F.struct(i.alias("at"), F.array_join(F.slice(F.col("w"), i + 1, k), " ").alias("gram"))
    found = F.flatten(F.transform("places", lambda i: F.array(gram(i, PAIR), gram(i, GRAM))))
    none = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("gram")))
    rows = rows.withColumn("places", places).select("doc_id", "key", "size", F.col("n").cast("long").alias("n_words"), F.explode(F.concat(none, found)).alias("g"))
    return rows.select("doc_id", "key", "size", "n_words", "g.at", "g.gram")


def held(neighbours: str, diagonal: str) -> F.Column:
    """(first, last, n) of the distinct places, ascending in template and text, on the merged diagonals."""
    points = F.flatten(F.transform(neighbours, lambda x: F.transform(x["own"], lambda p: F.struct(p.alias("place"), F.abs(x["diagonal"] - F.col(diagonal)).alias("off"), (x["diagonal"] + p).alias("at")))))
    start = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(-1 << 30).alias("at"), F.lit(0).alias("n"))

    def step(acc, x):
        taken = F.struct(F.when(acc["n"] == 0, x["place"]).otherwise(acc["first"]).alias("first"), x["place"].alias("last"), x["at"].alias("at"), (acc["n"] + 1).alias("n"))
        return F.when((x["place"] > acc["last"]) & (x["at"] > acc["at"]), taken).otherwise(acc)

    return F.aggregate(F.array_sort(points), start, step)


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    score is the largest share of a template's places that a labelled span holds.  Null and empty texts have no words and
    no labels.  Rows that are equal in doc_id and text are scanned together and each returned; an empty table gives no
    rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows, places = grams(spark, docs), template_places(spark)
    # a gram of the text is never the empty string, so only the first row meets template -1
    hits = rows.join(F.broadcast(places), (F.xxhash64(rows["gram"]) == places["hash"]) & (rows["gram"] == places["gram"])).drop("gram", "hash")
    text_row = ["doc_id", "key", "size", "n_words"]
    place = [*text_row, "t", "places", "kind", "label"]
    votes = hits.groupBy(*place, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"), F.collect_set("place").alias("own"))
    near = W.partitionBy("doc_id", "key", "size", "t").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    merged = votes.withColumn("most", F.sum(F.when(F.col("t") >= 0, F.size("own"))).over(near)).withColumn("around", F.collect_list(F.struct("diagonal", "own")).over(near))
    real = F.col("t") >= 0
    stands = (F.col("kind") == "base") & (F.size("own") == F.col("places"))
    need = F.when(F.col("kind") == "name", F.col("places") - F.when(F.col("places") >= SPARE_FROM, 1).otherwise(0)).otherwise(F.ceil(F.col("places") * TEXT_PERCENT / 100))
    judged = merged.withColumn("h", F.when(real & (F.col("kind") != "base") & (F.col("most") >= need), held("around", "diagonal")))
    whole = (F.col("kind") == "text") | (F.col("h.first") == 0) & (F.col("h.last") == F.col("places") - 1)
    judged = judged.withColumn("stands", stands).withColumn("named", F.coalesce(stands | (F.col("h.n") >= need) & whole, F.lit(False)))
    share = F.when(F.col("stands"), F.lit(1.0)).otherwise(F.col("h.n") / F.col("places"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c), F.col("label")))), ",")
    out = judged.groupBy(*text_row).agg(
        F.count(F.when(F.col("stands"), 1)).alias("n_base"),
        F.min(F.when(F.col("stands"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("stands"), F.col("diagonal"))).cast("long").alias("last_word"),
        joined("stands").alias("base_labels"),
        joined("named").alias("labels"),
        F.coalesce(F.max(F.when(F.col("named"), share)), F.lit(0.0)).alias("score"),
        F.max(F.when(~real, F.col("votes"))).alias("copies"),
    )
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return out.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*columns)
