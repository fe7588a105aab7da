import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from hearthline.llm import simhash
from hearthline.llm.queries import ORACLE_SQL, QUERIES


def test_stages_on_a_small_corpus(spark, prose, tmp_path):
    rng, rows, labels = random.Random(3), [], []
    shared = prose(70, 5)
    for i in range(400):
        words = prose(80, i).split()
        toxic = i % 8 == 0
        for _ in range(5 * toxic):
            words.insert(rng.randrange(80), rng.choice(("gromp", "snarl")))
        if i % 10 == 1:
            words += shared.split()
        rows.append((i, " ".join(words), "en", "ab"[i % 2], 0))
        labels.append((i, 1, int(toxic)))
    copies = [(1000 + i, rows[i][1], "en", "a", 0) for i in range(0, 400, 7)]
    near = []
    for i in range(3, 400, 40):
        words = rows[i][1].split()
        words[40] = "edited"
        near.append((2000 + i, " ".join(words), "en", "b", 0))
    odd = [(3000, None, None, None, 0), (3001, "", "en", None, 0), (3001, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + copies + near + odd, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{number}")
    ids = {n: [r.doc_id for r in kept[n].collect()] for n in kept}
    toxic = {i for i in range(0, 400, 8)}
    assert len(toxic & set(ids["toxicity"])) <= 2 and len(set(range(400)) - toxic - set(ids["toxicity"])) <= 4
    once = ids["near_duplicates"]
    assert len(once) == len(set(once)) and not {1000 + i for i in range(0, 400, 7)} & set(once)
    assert len([i for i in once if 2000 <= i < 3000]) <= 1 and set(ids["near_duplicates"]) >= set(range(1, 400, 8)) & set(ids["toxicity"])
    assert sorted(ids["substring_dedup"]) == sorted(once)
    assert not any(shared in (r.text or "") for r in kept["substring_dedup"].collect())
    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = sum(len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    assert sum(r.length for r in kept["packing"].collect()) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["packing"].count()
    assert np.isclose(len(ids["mixing"]), len(once), rtol=0.3)


def test_near_duplicates_are_those_of_simhash_and_of_the_set_join(spark, documents, prose):
    def edited(seed, **places):
        words = prose(40, seed).split()
        for place, word in places.items():
            words[int(place[1:])] = word
        return " ".join(words)

    # Rows 3 and 9 share 0.76 of their shingles, but their fingerprints are two bits apart; 9 and 12 share 0.85.
    # Rows 4 and 5 share 0.76 too, with fingerprints further apart.
    texts = [(9, edited(0)), (3, edited(0, w20="edit861")), (12, edited(0, w1="other", w39="end")), (4, edited(1)), (5, edited(1, w20="edit")), (6, None), (7, None)]
    texts += [(None, edited(0)), (8, edited(2)), (8, edited(2)), (8, edited(3))]
    docs = documents([(i, t, "a") for i, t in texts])
    by = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.where("doc_id < 8"), shingle=5, distinct=True).collect()}
    assert by[4] != by[5] and by[6] == by[7]
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(3, edited(0, w20="edit861")), (4, edited(1)), (5, edited(1, w20="edit")), (6, None), (8, edited(2)), (8, edited(3)), (None, edited(0))]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in want)


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in QUERIES
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
