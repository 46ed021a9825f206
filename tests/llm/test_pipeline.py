import math
import re

import corpus_pipeline as p
from hearthspark.llm import decontaminate, sampling, simhash, toxicity
from tests.llm import test_decontaminate, test_secrets, test_simhash

SF = "/root/testdata/sf0.001"


def plain_score(model, text):
    """The chain word by word, as it is defined."""
    theta, own = model.theta.astype(float).tolist(), toxicity._OWN
    slots = [toxicity.slots(w) for w in re.findall(r"[^\W\d_]+", text or "")]
    to, out, stay = map(math.exp, theta[-3:])
    x, y, log_z = 1.0, 0.0, 0.0
    for i, s in enumerate(slots):
        e = math.exp(theta[-4] + sum(theta[k] for k in s[:own]) + (theta[slots[i - 1][own]] if i else 0.0) + (theta[slots[i + 1][own + 1]] if i + 1 < len(slots) else 0.0))
        x, y = x + y * out, (x * to + y * stay) * e
        log_z, x, y = log_z + math.log(x + y), x / (x + y), y / (x + y)
    odds = max(-20.0, min(20.0, math.log(math.expm1(log_z)) if 1e-9 < log_z < 30 else log_z if log_z >= 30 else -20.0))
    return 1 / (1 + math.exp(-model.link[0] - model.link[1] * odds))


def test_stages_match_brute_force(spark):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = p.drop_toxic(spark, docs, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {i for i, r in rows.items() if plain_score(model, r["text"]) < 0.5}
    assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == docs.columns

    kept = p.drop_near_duplicates(spark, docs, SF)
    fps = {i: test_simhash.brute_fingerprint(r["text"]) for i, r in rows.items()}
    label = {i: i for i in rows}
    for _ in rows:
        new = {i: min(label[j] for j in rows if (fps[i] ^ fps[j]).bit_count() <= simhash.DISTANCE) for i in rows}
        if new == label:
            break
        label = new
    assert {r["doc_id"] for r in kept.collect()} == set(label.values()) and kept.columns == docs.columns

    kept = p.drop_contaminated(spark, docs, SF)
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    order = sorted(rows)
    bad = [x[4] for x in test_decontaminate.brute([rows[i]["text"] for i in order], items)]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, b in zip(order, bad, strict=True) if not b} and decontaminate.SHARE == 20

    out = {r["doc_id"]: r for r in p.redact_secrets(spark, docs, SF).collect()}
    assert out.keys() == rows.keys()
    for i, r in out.items():
        spans = test_secrets.brute(rows[i]["text"])
        assert not spans and r == rows[i] or "[SECRET]" in r["text"] and not test_secrets.brute(r["text"]) and r["n_chars"] == len(r["text"])


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, "same words here", "en", "s", 1), (1, "same words here", "en", "s", 1), (None, "same words here", None, None, None), (None, None, None, None, None), (None, "a text without an id that stays whole", None, None, 5), (2, "token=abcdefabcdef0123 tail", "en", "s", 27)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "None", "None"] and all(r["exact"] for r in got)
    redacted = {r["doc_id"]: r["text"] for r in p.redact_secrets(spark, docs, str(tmp_path)).collect()}
    assert redacted[2] == "[SECRET] tail"
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None and sampling.K == 3
