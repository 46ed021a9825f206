import corpus_pipeline as p
from hearthspark.llm import secrets as s


def test_value_copied_within_one_source_is_shared(spark):
    example, own, key = "example0example0example0AB", "owned11owned11owned11XY", "abcdefabcdef0123"
    rows = [(i, f"x {example} y token={key}", "en", "hot", 50) for i in range(40)] + [(100 + i, f"x {own} y", "en", "hot", 30) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in s.digest(s.scan_secrets(docs)).collect()}
    assert all((got[i]["spans"], got[i]["n_live"]) == ("assign:31:53,hex:37:53", 0) and got[i]["n_shared"] == 2 for i in range(40))
    assert all((got[i]["spans"], got[i]["n_live"]) == ("owned:2:25", 1) for i in range(100, 103))
    # The pipeline masks base spans anywhere and long tokens only where they look live.
    text = {r["doc_id"]: r["text"] for r in p.redact_secrets(spark, docs, "").collect()}
    assert text[0] == f"x {example} y [SECRET]" and text[100] == "x [SECRET] y"


def test_bound_counts_repositories_over_all_owners(spark):
    value = "example0example0example0AB"
    for n, live in ((s.MAX_REPOS, True), (s.MAX_REPOS + 1, False)):
        # A document that repeats counts once.
        rows = [(i, value, "ab"[i % 2]) for i in range(n)] * 2
        got = s.digest(s.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
        assert {r["n_live"] for r in got} == {int(live)} and len(got) == 2 * n
