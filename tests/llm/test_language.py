from tidelog.llm import language


def test_agreement_with_declarations(spark, sf):
    got = language.op2(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r.lang_id == r.lang for r in got) >= 0.98 * len(got)
    # Without the declared language the text and the other evidence still tell it.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    logs = language.fit(docs.selectExpr("text", "lang as declared"), ["de", "en", "es", "fr"])
    table, right, n = language._letters(), 0, 0
    for r in docs.where("length(text) > 60").collect():
        g = language.trigrams(r.text, table)
        right += ["de", "en", "es", "fr", "other"][int(logs[g].sum(axis=0).argmax())] == r.lang
        n += 1
    assert right >= 0.97 * n


def test_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, "12 !? "), (4, "le la les des une que est dans pour avec " * 30), (4, "x"), (None, "the of and to in is that for it as with")]
    df = frame(rows)
    assert language.languages_of(df.limit(2).selectExpr("lang as declared")) == [] and language.languages_of(df.selectExpr("lang as declared")) == ["en"]
    kept = language.identify(df, "text", declared="lang", host="source", languages=("de", "en", "es", "fr"), keep=True)
    got = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns and 4 in got and not got & {1, 2, 3}
    assert language.identify(frame([]), "text", carry=("doc_id",)).count() == 0
    assert {r.accepted for r in language.identify(df.where("doc_id = 2"), "text", carry=("doc_id",)).collect()} == {False}


def test_priors_are_smoothed_towards_suffix_and_whole(spark):
    rows = [("com", "a", "en")] * 50 + [("com", "b", "fr")] + [("fr", "c", "fr")] * 30 + [("fr", "d", None)]
    df = spark.createDataFrame(rows, "suffix string, host string, declared string")
    got = {r.host: (r.n, r.mid) for r in language.priors(df, ["en", "fr"])[0].collect()}
    out = {h: language.host_prior(*x, None) for h, x in got.items()}
    assert out["a"][0] > out["b"][0] > out["b"][1] and out["d"][1] > out["d"][0] and out["c"][1] > out["d"][1]
    alone = language.host_prior(*got["b"], 1)  # b's only declaration is the row's own
    assert alone[1] < out["b"][1] and alone[0] > out["b"][0]


def test_languages_come_from_the_rows_and_others_are_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "lang", "source")
    assert language.languages_of(docs.selectExpr("lang as declared")) == ["de", "en", "es", "fr"]
    strange = [(10**6 + k, " ".join("".join(chr(0x430 + (7 * k + 3 * i + j * j) % 32) for j in range(7)) for i in range(40)), None, "s") for k in range(5)]
    strange += [(10**6 + 5, "xqzvk wjqpz kxvwq zzqkj vwxqz " * 20, None, "s")]
    got = language.identify(docs.unionByName(spark.createDataFrame(strange, docs.schema)), "text", "lang", host="source", carry=("doc_id",)).collect()
    assert {(r.lang_id, r.accepted) for r in got if r.doc_id >= 10**6} == {("other", False)}
    assert sum(r.accepted for r in got if r.doc_id < 10**6) >= 0.98 * docs.count()


def test_pages_edges(spark):
    rows = [(1, None, None), (2, "http://a.fr/x", ""), (2, "::bad::", "<p>"), (None, "https://b.de", "<html lang=de><p>" + "der die das und ist nicht ein mit " * 9), (3, "http://a.fr", "<script>" + "x" * 10**6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = language.identify(language.from_pages(df), "text", "declared", "suffix", "host", languages=("de", "fr"), carry=("page_id",))
    assert got.count() == 5 and language.from_pages(df.where("false")).count() == 0


def test_pages(spark, sf):
    got = language.langid_pages(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert sum(r.lang_id == r.declared for r in got) >= 0.97 * len(got)


def test_accuracy_on_rows_left_out_of_the_fit(spark, sf):
    docs, languages = spark.read.parquet(f"{sf}/documents.parquet"), ["de", "en", "es", "fr"]
    logs, table = language.fit(docs.where("doc_id % 2 = 0").selectExpr("text", "lang as declared"), languages), language._letters()
    rows = docs.where("doc_id % 2 = 1 and length(text) > 60").collect()
    right = sum([*languages, "other"][int(logs[language.trigrams(r.text, table)].sum(axis=0).argmax())] == r.lang for r in rows)
    print("left out:", right, "of", len(rows))
    assert rows and right >= 0.97 * len(rows)
