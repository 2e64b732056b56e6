"""Problem 9 on pages of the tests' own making."""

import random

import pytest

pytest.importorskip("fieldtrace.llm")
from pyspark.sql import functions as F  # noqa: E402

from fieldtrace.llm import spam  # noqa: E402

NOUNS = "valve collar trestle sealant grinder ladder bracket washer hinge gasket trowel bucket scaffold dowel mortar primer spirit varnish router clamp mixer pulley anchor bolt rivet saw oil mat rod nut jig hub rag cap".split()
SHOPS = ["buy", "cheap", "sale", "online", "discount", "near me", "best price", "shop"]
TOWNS = ["Elmsgate", "Norhaven", "Vesterby", "Karlsmoor"]
OTHER = {
    "Cyrillic": ("насос клапан труба фитинг шланг ведро лестница дрель замок петля краска грунт".split(), ["купить", "цена", "дешево", "скидка"], ["Перед работой основание должно быть сухим и чистым, а поверхность без пыли.", "После высыхания покрытие можно мыть водой, но не раньше чем через сутки.", "При втором осмотре мастер не нашёл на стене ни трещин, ни следов влаги."]),
    "Greek": ("αντλία βαλβίδα σωλήνας κουβάς σκάλα τρυπάνι κόλλα χρώμα βίδα σφυρί".split(), ["αγορά", "φτηνά", "προσφορά"], ["Η επιφάνεια πρέπει να είναι στεγνή και καθαρή πριν από την εφαρμογή του υλικού.", "Μετά το στέγνωμα το χρώμα μπορεί να πλυθεί με νερό, αλλά όχι πριν από μία ημέρα.", "Στον δεύτερο έλεγχο ο τεχνίτης δεν βρήκε στον τοίχο ούτε ρωγμές ούτε υγρασία."]),
    "Arabic": ("مضخة صمام أنبوب دلو سلم مثقاب غراء طلاء برغي مطرقة".split(), ["شراء", "رخيص", "خصم"], ["يجب أن يكون السطح جافا ونظيفا قبل وضع المادة عليه في كل مرة.", "بعد أن يجف الطلاء يمكن غسله بالماء ولكن ليس قبل مرور يوم كامل.", "في الفحص الثاني لم يجد العامل على الجدار أي شقوق ولا أثر للرطوبة."]),
    "CJK": (["水泵", "阀门", "水管", "胶水", "油漆", "螺丝", "锤子", "梯子"], ["便宜", "促销", "购买"], ["使用前请确认基面干燥、清洁,并检查包装上的日期是否有效。", "干燥后涂层可以用水清洗,但必须等待至少一整天才能进行。", "第二次检查时,工人没有在墙上发现任何裂缝,也没有潮湿的痕迹。"]),
}


def spam_text(rnd):
    kind, words = rnd.randrange(5), rnd.sample(NOUNS, 3)
    phrase = lambda: " ".join(rnd.sample([rnd.choice(words) + " " + rnd.choice(NOUNS), rnd.choice(SHOPS + TOWNS)], 2))
    if kind == 0:
        return "\n".join(phrase() for _ in range(rnd.randint(12, 40)))
    if kind == 1:
        return " ".join("#" + rnd.choice(NOUNS) for _ in range(rnd.randint(15, 50)))
    if kind == 2:
        return "\n".join(f"https://shop-{rnd.choice(NOUNS)}.example/{rnd.choice(NOUNS)}/{rnd.randint(1, 9999)}" for _ in range(rnd.randint(8, 30)))
    if kind == 3:
        k = " ".join(words[:2])
        return " ".join(rnd.choice([f"Buy {k} in {rnd.choice(TOWNS)}, because our {k} is the best {k} for {k} buyers.", f"No {k} beats our {k}; compare {k} with {k} and {k}.", f"This {k} shop has {k}, {k} and more {k}."]) for _ in range(rnd.randint(4, 12)))
    return ", ".join(phrase() for _ in range(rnd.randint(20, 60)))


def content_text(rnd):
    n = lambda: rnd.choice(NOUNS)
    sentences = [
        lambda: f"Before you fix the {n()} to the {n()}, make sure that the {n()} is dry and free of dust.",
        lambda: f"The {n()} was tested for {rnd.randint(3, 90)} days on a wall that had been wet before.",
        lambda: f"If the {n()} doesn't hold, it should be taken off and cleaned with a cloth, since the {n()} won't stick otherwise.",
        lambda: f"A reviewer found that none of the {n()} sheets says how the {n()} has to be stored in winter.",
        lambda: f"It is not clear whether the {n()} may be used with the {n()} when both are new."]
    text = " ".join(rnd.choice(sentences)() for _ in range(rnd.randint(4, 14)))
    extra = rnd.randrange(5)
    if extra == 0:
        text += "\n" + "\n".join(f"{rnd.randint(1, 40)} x {n()} {n()}, {rnd.randint(1, 30)} kg, {rnd.randint(1, 900)}.90 EUR" for _ in range(8))
    if extra == 1:
        text += "\nTags: " + ", ".join(n() for _ in range(4))
    if extra == 2:
        text = "\n".join(f"{n().title()} | {rnd.randint(1, 900)} mm" for _ in range(10)) + "\n" + text
    return text


def corpus(seed=4, rows=900):
    rnd = random.Random(seed)
    return [(k, spam_text(rnd) if k % 4 == 0 else content_text(rnd), f"https://h{k % 9}.example/{k}") for k in range(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, url string, score string, label int")


def test_voters_and_trees(spark):
    rows = corpus() + [(9_000, None, None), (9_001, "", "not a url"), (9_002, " \n\t", None), (None, "buy valve", None), (8_000, corpus()[0][1], None), (8_000, corpus()[0][1], None)]
    df = frame(spark, rows)
    scored = spam.score_pages(df)
    assert scored.count() == len(rows) - 1
    got = {r["doc_id"] for r in scored.filter("score >= 0.5").collect()}
    want = {k for k in range(900) if k % 4 == 0} | {8_000}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want) and not got & {9_000, 9_001, 9_002, None}
    assert spam.spam_pages(df.limit(0)).count() == 0
    # one class alone teaches nothing
    assert spam.spam_pages(df.filter("doc_id % 4 <> 0")).count() == 0


def test_no_single_feature_says_what_the_trees_say(spark):
    df = frame(spark, corpus())
    verdict = {r["doc_id"]: r["page_score"] >= 0.5 for r in spam.score_pages(df).collect()}
    pages = spam.page_features(df).toPandas()
    said = pages["doc_id"].map(verdict).to_numpy()
    for f in spam.FEATURES:
        values = pages[f].to_numpy()
        best = max(max(((values >= c) == said).mean(), ((values < c) == said).mean()) for c in sorted(set(values))[:: max(1, len(set(values)) // 200)])
        assert best < 0.99, f
    # and the labels are made by none of the features' rules: the voters abstain on these scripts
    assert spam.doubtful("αντλία φτηνά\nβαλβίδα αγορά") is None and spam.doubtful("便宜水泵\n阀门促销") is None


def test_keyword_lists_in_five_scripts(spark):
    rnd = random.Random(8)
    rows, want = corpus(), set()
    for s, (nouns, shops, sentences) in enumerate(OTHER.values()):
        for k in range(12):
            n = 20_000 + s * 100 + k
            if k % 2:
                rows.append((n, "\n".join(" ".join(rnd.sample([rnd.choice(nouns), rnd.choice(nouns), rnd.choice(shops)], rnd.randint(2, 3))) for _ in range(25)), None))
                want.add(n)
            else:
                rows.append((n, " ".join(rnd.sample(sentences, 3)), None))
    got = {r["doc_id"] for r in spam.spam_pages(frame(spark, rows)).filter("doc_id >= 20000").collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 2
    # the fifth script is the corpus itself, see test_voters_and_trees


def test_hosts_move_what_the_trees_leave_open(spark):
    rows = [(k, "spam.example" if k < 200 else "clean.example", 0.95 if k < 190 else 0.02) for k in range(400)] + [(500, "spam.example", 0.4), (501, "clean.example", 0.6), (502, None, 0.4), (503, "spam.example", 0.02), (504, "new.example", 0.6)]
    judged = spark.createDataFrame(rows, "doc_id long, host string, page_score double")
    moved = judged.join(spam.host_shift(judged), "host", "left").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    held = spark.createDataFrame([(k, 1.0 if k < 195 else 0.0) for k in range(150, 250)], "doc_id long, label double")
    weight = spam.host_weight(moved, held)
    assert weight == 1.0  # held-out pages follow their hosts
    score = {r["doc_id"]: r["s"] for r in moved.select("doc_id", spam._moved(F.col("page_score"), F.col("shift"), weight).alias("s")).collect()}
    assert score[500] > 0.5 > score[501] and score[502] < 0.5 and score[503] < 0.5 and score[504] > 0.5
    against = spark.createDataFrame([(500, 0.0), (501, 1.0)], "doc_id long, label double")
    assert spam.host_weight(moved, against) == 0.0
    # a host's rate is the same however its pages are spread
    assert spam.host_shift(judged.limit(0)).count() == 0


def test_features_of_odd_texts():
    for text in (None, "", " \n\t", "\x00"):
        assert spam.features(text)[0] == 0 and set(spam.features(text)[1:]) == {0.0}
    assert spam.features("x" * 200_000)[0] == 1
    f = dict(zip(["pieces", *spam.FEATURES], spam.features("see https://a.example/x and [label](https://b.example/y)", "a.example")))
    assert f["hosts_per_link"] == 1 and f["self_links"] == 0.5 and f["anchor_share"] > 0


def test_features_use_the_end_of_a_text(monkeypatch):
    told = lambda text: dict(zip(["pieces", *spam.FEATURES], spam.features(text)))
    rnd = random.Random(2)
    again = "The seal holds on a wet wall. " * 7_000
    other = " ".join("".join(rnd.choices("abcdefghijжé", k=9)) for _ in range(21_000))
    assert len(again) > 200_000 and len(other) > 200_000
    alone, first, after = told(again)["shrink"], told(again + other)["shrink"], told(other + again)["shrink"]
    assert alone < 0.02 and first > 0.2 and abs(first - after) < 0.02
    monkeypatch.setattr(spam, "PACKED_CHARS", 1_000)
    assert abs(told(again + other)["shrink"] - first) < 0.001 and told("")["shrink"] == 0
    # words behind the last full window
    words = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnop"]
    for rest in (2, 29, 30, 31, 89, 90):
        assert told(" ".join(words + ["valve"] * rest))["window_distinct"] < 1, rest
    assert told(" ".join(words + ["valve"] * 29))["window_top"] == 29 / 89
