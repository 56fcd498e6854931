import numpy as np
import pytest

from tessera.llm.residue import fit, framed, margins, residue, residue_documents, segments, train

REAL = ["Loss of OPA1 doubled the peak width in MIN6 clusters.", "重新分析 72 个培养皿后，占空比由 5.3 改为 9.2。", "Die Messung mit TMRM ergab 3.2 Einheiten.", "No se probó si PC es necesaria para la fusión."]
CASES = [
    ("Overexpressed {{gene}} reached the nucleoid.", "slot"), ("Per-islet medians of %%TIME_POINT%% ranged.", "slot"), ("We saw [dose to be added] of it.", "slot"), ("该研究没有检XXXX验因果作用。", "slot"), ("在【此处填写剂量】后恢复。", "slot"),
    ("{ dose } of metformin", "slot"), ("The [CellLine] kept it.", "slot"), ("The _____ of the matrix", "slot"), ("Loss of <insert gene> fell.", "slot"),
    ("the dose of @@first_author@@ rose", "slot"), ("lost (section: ???) signal", "slot"), ("敲低 NNT（请补充时相）使其下降", "slot"), ("Dear [Your Name], the dose", "slot"), ("given %COMPOUND% for 3 h", "slot"),
    ("Lorem ipsum dolor sit amet.", "filler"), ("这里是占位文本，请替换。", "filler"), ("Click to add text", "filler"),
    ("404 Not Found", "error"), ("HTTP Status 503 – Service Unavailable", "error"), ("Access denied.", "error"), ("页面不存在或已被删除。", "error"),
    ("Please enable JavaScript to view this article.", "notice"), ("您的浏览器未启用 JavaScript，无法显示正文。", "notice"),
    ("The annotation guide shows the slot syntax as `{{species}}` and forbids it in exports.", None), ("Membrane potential is written $\\Delta\\Psi_{m}$ throughout.", None), ("Set {A, B} of islets and set {C} were scored.", None),
    ('The tool log holds {"tool": "read_passage", "arguments": {"limit": 3}} for each step.', None), ("Values below the detection limit [3 pM] were not filled in.", None), ("For 12 papers the XML request returned HTTP 404, and these were kept as metadata only.", None),
    ("The review site filters records with JavaScript, and a static table is shipped for readers without it.", None), ("Access to raw images was denied for 12 dishes by the data committee.", None), ("An error term of 3 units was assumed in the power calculation.", None),
]


@pytest.mark.parametrize("text, kind", CASES + [(t, None) for t in REAL])
def test_exact_check(text, kind):
    assert residue(text) == kind


def test_segments_keep_all_of_a_text():
    text = "- One. Two!\n\n## 三。四？\nfive"
    assert segments(text) == ["One.", "Two!", "三。", "四？", "five"] and segments(" \n") == []


def documents(spark, n=240):
    rows = []
    for k in range(n):
        text = " ".join(REAL[(k + j) % 4].replace("72", str(k)) for j in range(3))
        bad = k % 4 == 0
        if bad:
            text += " " + CASES[k % 23][0]
        elif k % 3 == 0:
            text += " " + CASES[23 + k % 9][0]
        rows.append((k, text, f"host{k % 11}", None if k % 2 else "A title", bad))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, title string, kinds boolean").repartition(3)


def test_model_finds_what_the_rules_uphold(spark):
    rows, df = documents(spark)
    model = train(df)
    got = {r["doc_id"]: r for r in residue_documents(df, model).collect()}
    assert set(got) == {k for k, *_, bad in rows if bad}
    assert all(r["kinds"] and 0 < r["share"] <= 1 for r in got.values())
    assert model.report["precision"] > 0.9 and model.report["recall"] > 0.5


def test_model_alone_on_unseen_hosts(spark):
    """The exact check takes no part here: what the model takes at margin 0, over documents of hosts it was not fitted on."""
    rows, df = documents(spark, 1200)
    from tessera.llm.residue import _is_held_out

    model = train(df)
    unseen = {k: bad for k, _, host, _, bad in rows if _is_held_out(host)}
    got = {r["doc_id"] for r in residue_documents(df, model, checked=False).collect()} & set(unseen)
    true = {k for k, bad in unseen.items() if bad}
    assert true and len(got & true) >= 0.95 * len(true) and len(got & true) >= 0.95 * len(got)


def test_held_out_accuracy():
    rng = np.random.default_rng(0)
    parts = [REAL[i % 4].replace("72", str(i)) + (" {{x%d}}" % i if i % 2 else f" ({i})") for i in range(400)]
    labels, none = np.array([i % 2 for i in range(400)], float), np.zeros(400, int)
    order = rng.permutation(400)
    use, rest = order[:300], order[300:]
    windows = [framed(p)[-64:] for p in parts]
    weights = fit([windows[i] for i in use], labels[use], none[:300] + 60, none[:300], none[:300])
    got = margins(weights, [parts[i] for i in rest], none[:100], none[:100])
    assert ((got > 0) == labels[rest]).mean() > 0.97


def test_margin_of_a_long_segment_is_that_of_its_best_window():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << 18) + 1)
    text = "".join(rng.choice(list("abc {}1")) for _ in range(500))
    one = np.zeros(1, int)
    whole = framed(text)
    from tessera.llm.residue import EXTRA, STRIDE, WINDOW, _extra, _grams

    families, _ = _grams([whole])
    score = np.zeros(len(whole))
    for ids, at in families:
        score[at] += weights[ids]
    starts = sorted({*range(0, len(whole) - WINDOW, STRIDE), len(whole) - WINDOW})
    best = max(score[a : a + WINDOW].sum() for a in starts)
    assert np.isclose(margins(weights, [text], one, one)[0], best + EXTRA * weights[_extra(np.array([500]), one, one)].sum() + weights[-1])


def test_nulls_long_and_empty(spark):
    _, df = documents(spark)
    model = train(df)
    odd = spark.createDataFrame([(1, None, "h", None), (2, "", "h", None), (3, REAL[0] * 20_000 + " {{gene}}", "h", None), (3, REAL[0] * 20_000 + " {{gene}}", "h", None), (None, "{{x}}", None, None)], "doc_id long, text string, source string, title string")
    assert [r["doc_id"] for r in residue_documents(odd, model).collect()] == [3]
    assert residue_documents(df.limit(0), train(df.limit(0))).count() == 0


def test_slot_in_a_long_line_without_sentence_ends(spark):
    model = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    line = REAL[0].rstrip(".").replace(". ", ", ") + ", "
    rows = [(n, line * n + "and {{gene}} then " + line * n, "h", None) for n in (3, 40, 4000)] + [(5, line * 40, "h", None)]
    got = residue_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, title string"), model).collect()
    assert {r["doc_id"] for r in got} == {3, 40, 4000}
