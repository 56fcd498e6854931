import pytest

from tessera.llm.mixing import TOKENIZER, _encoding, mixture, shares, with_tokens


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string").repartition(4)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_tokens_round_trip(spark):
    texts = ["The Ca²⁺ signal rose.", "胰岛 <|endoftext|>", "", None, "x " * 50_000]
    got = {r["doc_id"]: r["tokens"] for r in with_tokens(table(spark, [(k, t, "s", "") for k, t in enumerate(texts)]), "doc_id", "text", "source").collect()}
    encoding = _encoding(TOKENIZER)
    for k, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert got[k] == len(ids) and encoding.decode(ids) == (t or "")


def test_shares_and_caps(spark):
    rows = [(k, f"word{k} " * (5 + k % 37), "big" if k % 3 else "small", "") for k in range(900)]
    rows += [(1000 + k, "tiny text of a source " * 4, "tiny", "") for k in range(12)] + [(2000, "left out", "other", ""), (2001, "zero share", "zero", "")]
    wanted = [("big", 0.5, 2), ("small", 0.3, 3), ("tiny", 0.1, 3), ("absent", 0.1, 2), ("zero", 0.0, 4), ("zero", 0.0, 4)]
    mixed, limits = mixture(table(spark, rows), targets(spark, wanted))
    got = {r["domain"]: r for r in shares(mixed, limits).collect()}
    for name, share in (("big", 5 / 9), ("small", 3 / 9), ("tiny", 1 / 9)):
        assert got[name]["reachable_share"] == pytest.approx(share)
        assert got[name]["actual_share"] == pytest.approx(share, abs=0.003)
    assert got["tiny"]["most_repeats"] == 3 and got["tiny"]["used_tokens"] == 3 * got["tiny"]["tokens"]
    assert got["absent"]["actual_share"] == got["zero"]["used_tokens"] == got["other"]["used_tokens"] == 0
    assert all(r["most_repeats"] <= (r["cap"] or 0) for r in got.values())
    assert mixed.count() == len(rows)


def test_unlabelled_documents_follow_their_words(spark):
    rows = [(k, ("alpha beta gamma " if k % 2 else "uno dos tres ") * 9, ("a" if k % 2 else "b") if k < 200 else None, "") for k in range(260)]
    mixed, limits = mixture(table(spark, rows), targets(spark, [("a", 0.75, 2), ("b", 0.25, 2)]))
    used = mixed.where("domain IS NULL").collect()
    per = {side: [r["repeats"] for r in used if r["doc_id"] % 2 == side] for side in (0, 1)}
    assert sum(per[1]) > 2 * sum(per[0]) and max(per[1]) <= 2


def test_empty_and_nulls(spark):
    docs = table(spark, [(1, None, "a", ""), (2, "", "a", ""), (None, "x", "a", "")])
    mixed, _ = mixture(docs, targets(spark, [("a", 1.0, 2), (None, 0.5, 1)]))
    assert sorted((r["doc_id"], r["repeats"]) for r in mixed.collect()) == [(1, 0), (2, 0)]
    mixed, limits = mixture(docs.limit(0), targets(spark, []))
    assert mixed.count() == 0 and shares(mixed, limits).count() == 0
