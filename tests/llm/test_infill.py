import hashlib
import random
import re

from pyspark.sql import functions as F

from hearthspark.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    n = len(tokens)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def test_query_matches_brute_force(spark):
    rng = random.Random(5)
    odd = [None, "", " ", "\n\n\t", "word", " word ", "a b c", "é\U0001f600 \U0001f600\r\nx", "has <P> mark", "half <P marks S> <", "<M>", "long " * 5000 + " end\n", "x" * 100_000]
    texts = [*odd, *("".join(rng.choice("ab \n<PSM>é\U0001f600") for _ in range(rng.randrange(400))) for _ in range(300))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a null id has a text", "x"), (3, "an id that repeats, with another text", "x"), (3, "an id that repeats, with another text", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = sorted((tuple(r) for r in infill.digest(infill.transform(df)).collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t, _ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_lanes_reach_every_rank():
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 255, 256, 257, 5000):
        text = "".join(rng.choice(["a", "bc ", " d\n", "é "]) for _ in range(n))
        widths = [len(t) for t in TOKEN.findall(text)]
        built = infill.lanes(infill.token_widths(text))
        assert [int(w) for w in built[0][1]] == widths and len(built[-1][0]) <= infill.FAN
        assert [infill.descend(built, r) for r in range(len(widths) + 1)] == [sum(widths[:r]) for r in range(len(widths) + 1)]


def test_rates_ids_and_empty_tables(spark):
    df = spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("some words to cut").alias("body"))
    always = infill.transform(df, "k", "body", rate=100, suffix_first=0)
    assert {r["form"] for r in always.collect()} == {"psm"} and always.schema["id"].dataType.simpleString() == "string"
    assert {r["form"] for r in infill.transform(df, "k", "body", rate=0).collect()} == {"plain"}
    assert infill.digest(infill.transform(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
