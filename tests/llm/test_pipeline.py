import corpus_pipeline as P


def table(spark, tmp_path, docs, labels, items):
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long, Toxicity string, masked string, leak string"),
                               ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path):
    clean = ["".join(chr(97 + (i * 7 + j * j) % 23) + ("." if j % 9 == 8 else "") + " " * (j % 4 == 3) for j in range(60 + i % 60)) for i in range(240)]
    item = "this very benchmark question must never be seen in training"
    docs = [(i, f"{t} number{i} {t[::-1]}" + (" idiot scum" if i % 3 == 0 else "")) for i, t in enumerate(clean)]
    copy = next(t for i, t in docs if i == 1)
    docs += [(900, copy), (901, None), (902, ""), (903, f"before {item.upper()} after"), (904, "my password=hunter2hunter2 is here")]
    d = table(spark, tmp_path, [(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in docs], [(i, 1, int(i % 3 == 0)) for i in range(240)], [(0, item)])
    read, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    cols = read.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, read, d)
        if k < 4:
            assert out.columns == cols
            seen[name] = {r["doc_id"]: r for r in out.collect()}
            read = spark.createDataFrame([tuple(r) for r in seen[name].values()], read.schema)
    tox = {i for i in range(240) if i % 3 == 0}
    left = set(seen["toxicity"])
    assert len(tox & left) <= 6 and len(set(range(240)) - tox - left) <= 6
    assert {901, 902} <= set(seen["ngram_join"]) and not {1, 900} <= set(seen["ngram_join"])
    assert 903 in seen["ngram_join"] and 903 not in seen["decontaminate"]
    r = seen["secret_scan"].get(904)
    assert r and r["text"] == "my [SECRET] is here" and r["n_chars"] == len(r["text"])
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(seen["secret_scan"]) and all(r["decoded"] for r in got.values())


def test_empty_documents(spark, tmp_path):
    d = table(spark, tmp_path, [], [], [])
    assert P.run(spark, d).count() == 0
