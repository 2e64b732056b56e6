"""Pages made of repeated keywords, links or tags instead of sentences.

Voters that know some languages (their function words, offers, links, stuffed
sentences) label a bounded sample of pages and abstain where they aren't sure.
Bagged decision trees learn from these labels on other features, which know no
language: how a page links, how its segments end, how long they are and how
often words come again. The trees judge every page, and the spam rate of a
page's host moves what they leave open, as far as held-out pages bear it out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace.operators.skew import salted_group, salted_join
from fieldtrace.runtime import cut

#: Pages shown to the voters, and bound of the labelled pages the trees are fitted on, half per label.
VOTE_ROWS, TRAIN_ROWS = 30_000, 8_000
#: Part of the labelled pages kept from the trees, to choose the host's weight.
HELD_OUT = 0.2
TREES = 20
DEPTH = 8
BAG = 0.7
#: A page is voted content or spam if at most or at least this part of its text is doubtful.
SURE_CONTENT, SURE_SPAM = 0.3, 0.6
#: Weights of the host's rate to choose from; how far it may move a page (in log odds); pages' worth of the global rate mixed into it.
HOST_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]
HOST_REACH = 1.5
HOST_PRIOR = 20.0
THRESHOLD = 0.5
#: Words of a window in which repetition is measured, so that long pages compare with short ones.
WINDOW = 60
#: Characters that are encoded at once when a text is compressed.
PACKED_CHARS = 1 << 20

# Frequent function words of the corpus' languages.
FUNCTION_WORDS = set((
    "the a an of and to in is was are be been it its it's that this these those with without by at from or as than not if has have had our your we you he she they his her their "
    "which who whose what when where while because so but can could will would should must may might about after before into over under between through during yet also only more most each every "
    "der die das den dem des ein eine einer eines einem und oder nicht mit von für auf im ist sind war wird werden wurde hat haben als auch bei nach vor zu zur zum aus über unter wenn weil dass daß er sie es wir ihr sich "
    "le la les un une des du de et ou ne pas pour par sur dans avec sans que qui est sont été a ont ce cette ces il elle ils se sa son leur leurs au aux plus mais si y en "
    "el los las una unos del al con sin por para que no es son fue ha han se su sus como más pero si cuando lo este esta estos entre hasta desde "
    "и в на не с по для при что если за из от до или как к у о об его её их это этот через после перед но а же"
).split())
#: Words of offers, in the corpus' languages.
OFFER_WORDS = set("buy cheap cheapest sale shop online discount best price prices deal deals offer offers order near free review reviews store kaufen günstig billig angebot angebote preis preise rabatt acheter achat prix promo soldes boutique comprar barato precio oferta tienda купить цена дешево скидка".split())

_LINK = re.compile(r"<a\b[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|(?<![\w@.])[a-z0-9-]+(?:\.[a-z0-9-]+)+/\S*", re.S)
_TARGET = re.compile(r"(?:https?:)?//([^/\s\"')>]+)|(?<![\w@.])((?:[a-z0-9-]+\.)+[a-z0-9-]+)/?")
_TAG = re.compile(r"(?<!\w)#\w+")
#: A word; in scripts without blanks between words each sign is one.
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e00-\u0e7f]|[^\W\d_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e00-\u0e7f]+")
_STOP = re.compile(r"[.!?\u061f](?=\s|$)|[。!?।]")
_SEGMENT = re.compile(r"[^.!?\u061f。!?।\n]+(?:[.!?\u061f](?!\s|$)[^.!?\u061f。!?।\n]*)*(?:[.!?\u061f]+(?=\s|$)|[。!?।]+)?")
_SEPARATOR = re.compile(r"[,;|>»•·/、,،]")
_YEAR = re.compile(r"(?<!\d)20\d\d(?!\d)")
_DIGIT = re.compile(r"\d")
_COUNTED = re.compile(r"^\W*[^\W\d][^\d():=|]*\(\d+\)\W*$")
_FIELD = re.compile(r"[:=|{}\[\]]")

_is_function = FUNCTION_WORDS.__contains__

FEATURES = [
    "link_share", "tag_share", "links_per_segment", "hosts_per_link", "self_links", "anchor_share",
    "ended_share", "joined_share", "listed_share", "figure_share", "stuffed_share", "separators", "short_words",
    "segment_words", "segment_spread", "window_distinct", "window_top", "window_pair", "shrink", "log_words",
]
_SCHEMA = "doc_id long, host string, pieces int, " + ", ".join(f"{f} double" for f in FEATURES)


def _stuffed(words: list[str], passes) -> bool:
    """One pair of words, or one word that doesn't pass, fills at least a fifth of the segment."""
    n = len(words)
    if len(set(words)) > 0.85 * n:  # nothing can occur often enough
        return False
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    _, most = pairs.most_common(1)[0]
    if most >= 3 and 2 * most >= 0.2 * n:
        return True
    single = max([c for w, c in counts.items() if not passes(w)], default=0)
    return single >= 3 and single >= 0.2 * n


def doubtful(text: str | None) -> float | None:
    """The voters' share of links, tags, keywords and stuffed sentences in a text.

    None where they can't tell: without words and links, and where most of the
    text is in a language whose function words they don't know.
    """
    low = (text or "").lower()
    body, tags = low, 0
    links = sum(map(len, _LINK.findall(low))) if "/" in low or "www." in low else 0
    body = _LINK.sub(" \x01 ", low) if links else low
    if "#" in body:
        tags = sum(map(len, _TAG.findall(body)))
        body = _TAG.sub(" ", body)
    keyword = stuffed = structured = sentence = unknown = 0
    for line in body.split("\n"):
        for piece in _STOP.split(line):
            words = _WORD.findall(piece)
            n = len(words)
            if not n:
                continue
            chars = len(piece.strip())
            f = sum(map(_is_function, words))
            if f * 12 >= n and (n >= 6 or f >= 2):
                if n >= 6 and _stuffed(words, _is_function):
                    stuffed += chars
                else:
                    sentence += chars
            elif f and n < 6:
                continue  # too short to tell
            elif not piece.isascii() and sum(w[0] > "\u024f" for w in words) > n / 2:
                unknown += chars
            elif "\x01" in piece or _COUNTED.match(piece):  # a link's label; a tag with its count
                keyword += chars
            elif _DIGIT.search(_YEAR.sub("", piece)) or (n <= 10 and _FIELD.search(piece)):
                structured += chars
            else:
                keyword += chars
    told = links + tags + keyword + stuffed + structured + sentence
    return (links + tags + keyword + stuffed) / told if told > unknown else None


def _shrink(text: str) -> float:
    """Compressed bytes over bytes of the whole text, encoded part by part."""
    packer, size, packed = zlib.compressobj(1), 0, 0
    for at in range(0, len(text), PACKED_CHARS):
        raw = text[at:at + PACKED_CHARS].encode("utf-8", "ignore")
        size += len(raw)
        packed += len(packer.compress(raw))
    return (packed + len(packer.flush())) / max(1, size)


def features(text: str | None, host: str | None = None) -> tuple:
    """(pieces, *FEATURES) of one text; zeros for null, empty and blank ones."""
    low = (text or "").lower()
    found = _LINK.findall(low) if "/" in low or "www." in low else []
    links = sum(map(len, found))
    body, hosts, own, anchors = low, set(), 0, 0
    if found:
        body = _LINK.sub(" ", low)
        for link in found:
            m = _TARGET.search(link)
            target = (m[1] or m[2]) if m else None
            hosts.add(target)
            own += target is not None and target == host
            if link[0] == "[":
                anchors += link.find("](") - 1
            elif link[0] == "<":
                anchors += max(0, link.rfind("<") - link.find(">") - 1)
    hashes = _TAG.findall(body) if "#" in body else []
    if hashes:
        body = _TAG.sub(" ", body)
    tags = sum(map(len, hashes))
    every: list[str] = []
    sizes: list[int] = []
    total = ended = joined = listed = figures = stuffed = short = separators = 0
    for segment in _SEGMENT.findall(body):
        words = _WORD.findall(segment)
        n = len(words)
        if not n:
            continue
        chars = len(segment.strip())
        total += chars
        sizes.append(n)
        every += words
        separators += len(_SEPARATOR.findall(segment))
        end = segment[-1] in ".!?\u061f。!?।"
        few = sum([len(w) <= 3 for w in words])
        if few > n / 2 and not segment.isascii() and sum(w > "\u2fff" or "\u0e00" <= w <= "\u0e7f" for w in words) > n / 2:
            few = n // 3 if end else 0  # scripts without blanks show no short words: the end of a sentence stands for them
        short += few
        if n >= 6:
            if 6 * few >= n:
                joined += chars
            if end:
                ended += chars
            if _stuffed(words, lambda w: len(w) <= 3 and w < "\u0250"):
                stuffed += chars
        elif not end:
            listed += chars
        if _DIGIT.search(_YEAR.sub("", segment)) or (n <= 10 and _FIELD.search(segment)):
            figures += chars
    words_n, pieces = len(every), len(sizes) + len(found) + len(hashes)
    if not pieces:
        return (0, *([0.0] * len(FEATURES)))
    whole = total + links + tags
    s, w, k = max(1, len(sizes)), max(1, words_n), max(1, len(found))
    distinct = top = pair = 0.0
    windows = 0
    last = (words_n - WINDOW // 2 - 1) // WINDOW * WINDOW  # its window takes a rest of up to half a window with it
    for at in range(0, max(0, last) + 1, WINDOW):
        part = every[at:at + WINDOW] if at < last else every[at:]
        m = len(part)
        if m < 2:
            continue
        windows += 1
        if len(set(part)) == m:  # nothing comes again
            distinct, top, pair = distinct + 1, top + 1 / m, pair + 2 / m
            continue
        counts = Counter(part)
        distinct += len(counts) / m
        top += max([c for x, c in counts.items() if len(x) > 3], default=0) / m
        pair += max(Counter(zip(part, part[1:])).values()) * 2 / m
    v = max(1, windows)
    mean = words_n / s
    shrink = _shrink(low)
    return (
        pieces, links / whole, tags / whole, len(found) / s, len(hosts) / k, own / k, anchors / max(1, links),
        ended / whole, joined / whole, listed / whole, figures / whole, stuffed / whole, separators / w, short / w,
        mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / s) / max(1.0, mean), distinct / v, top / v, pair / v, shrink, math.log1p(words_n),
    )


def _host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def page_features(documents: DataFrame) -> DataFrame:
    """(doc_id, host, pieces, *FEATURES), one row per document with an id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda v: v if isinstance(v, str) else None
        for f in frames:
            rows = [features(none(t), none(h)) for t, h in zip(f["text"], f["host"])]
            out = pd.DataFrame(rows, columns=["pieces", *FEATURES])
            out.insert(0, "host", f["host"])
            out.insert(0, "doc_id", f["doc_id"])
            yield out

    return documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _host(F.col("url")).alias("host")).mapInPandas(run, _SCHEMA)


def voted(documents: DataFrame, vote_rows: int = VOTE_ROWS) -> DataFrame:
    """(doc_id, label) of a sample of about ``vote_rows`` documents by a hash of the id; abstentions are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            share = [doubtful(t if isinstance(t, str) else None) for t in f["text"]]
            label = [None if d is None or SURE_CONTENT < d < SURE_SPAM else float(d >= SURE_SPAM) for d in share]
            yield pd.DataFrame({"doc_id": f["doc_id"], "label": label}).dropna()

    known = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    share = min(1.0, vote_rows / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return sample.mapInPandas(run, "doc_id long, label double").distinct()


def _balanced(labels: DataFrame, train_rows: int) -> DataFrame:
    """At most about ``train_rows`` labelled pages, half of them spam."""
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, train_rows / 2 / n) for k, n in counts.items()}
    bar = F.when(F.col("label") == 1.0, F.lit(share.get(1.0, 0.0))).otherwise(F.lit(share.get(0.0, 0.0)))
    return labels.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < bar * 1_000_000)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))
    return F.log(q / (1 - q))


def _moved(p: Column, shift: Column, weight: float) -> Column:
    """``p`` moved by the host's evidence in log odds."""
    return 1 / (1 + F.exp(-(_logit(p) + F.lit(weight) * shift)))


def host_shift(judged: DataFrame) -> DataFrame:
    """(host, host_rate, shift): the host's spam rate against that of all pages, in log odds, at most HOST_REACH.

    The rate is the mean of the trees' verdicts with ``HOST_PRIOR`` pages of the
    global rate mixed in, so a host of few pages says little.
    """
    overall = judged.agg(F.avg("page_score")).first()[0] or 0.0
    each = [F.sum("page_score").alias("s"), F.count("*").alias("n")]
    sums = salted_group(judged.filter("host is not null"), "host", each, [F.sum("s").alias("s"), F.sum("n").alias("n")])
    rate = (F.col("s") + HOST_PRIOR * overall) / (F.col("n") + HOST_PRIOR)
    away = _logit(F.col("host_rate")) - _logit(F.lit(float(overall)))
    return sums.select("host", rate.alias("host_rate")).withColumn("shift", F.greatest(F.lit(-HOST_REACH), F.least(F.lit(HOST_REACH), away)))


def host_weight(scored: DataFrame, held: DataFrame, weights: list[float] = HOST_WEIGHTS) -> float:
    """The weight under which held-out labelled pages are likeliest; the greatest on ties."""
    rows = scored.join(held, "doc_id")
    loss = lambda w: F.avg(-F.log(F.greatest(F.when(F.col("label") == 1.0, _moved(F.col("page_score"), F.col("shift"), w)).otherwise(1 - _moved(F.col("page_score"), F.col("shift"), w)), F.lit(1e-9))))
    got = rows.agg(*[F.round(loss(w), 4).alias(f"w{k}") for k, w in enumerate(weights)]).first()
    if got is None or got[0] is None:
        return weights[-1]
    return max(zip((-v for v in got), weights))[1]


def score_pages(documents: DataFrame, train_rows: int = TRAIN_ROWS, vote_rows: int = VOTE_ROWS) -> DataFrame:
    """(doc_id, host, page_score, host_rate, score) of every document.

    ``documents``: (doc_id, text, url). Null, empty and blank texts score 0 and
    teach nothing. Pages without a readable host have the rate of all pages.
    Where the votes hold only one class or none, nothing can be learned and the
    voters' own share is the score (0 where they abstain). Rows with a null
    doc_id are left out; repeated rows are scored each; an empty table gives no
    rows.
    """
    pages = cut(page_features(documents))
    labels = cut(voted(documents, vote_rows))
    chosen = cut(_balanced(labels, train_rows).withColumn("held", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(100)) < HELD_OUT * 100))
    train = cut(pages.join(chosen.filter("not held").select("doc_id", "label"), "doc_id").filter("pieces > 0"))
    if train.select("label").distinct().count() < 2:
        judged = _voters_only(documents)
        held = chosen.limit(0)
    else:
        gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
        # all features at every split: plain bagging
        bag = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=BAG, featureSubsetStrategy="all", bootstrap=True, seed=7, maxBins=64, minInstancesPerNode=2)
        model = bag.fit(gather.transform(train.coalesce(2)).select("label", "features"))
        told = model.transform(gather.transform(pages)).select("doc_id", "host", "pieces", vector_to_array("probability")[1].alias("p"))
        judged = told.select("doc_id", "host", F.when(F.col("pieces") > 0, F.col("p")).otherwise(0.0).alias("page_score"))
        held = chosen.filter("held").select("doc_id", "label")
    judged = cut(judged)
    overall = judged.agg(F.avg("page_score")).first()[0] or 0.0
    smoothed = salted_join(judged, host_shift(judged), "host", "left").withColumn("host_rate", F.coalesce("host_rate", F.lit(float(overall)))).withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    weight = host_weight(smoothed, held)
    score = F.when(F.col("page_score") > 0, _moved(F.col("page_score"), F.col("shift"), weight)).otherwise(0.0)
    return smoothed.select("doc_id", "host", "page_score", "host_rate", score.alias("score"))


def _voters_only(documents: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            share = [doubtful(t if isinstance(t, str) else None) or 0.0 for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "host": f["host"], "page_score": share})

    known = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _host(F.col("url")).alias("host"))
    return known.mapInPandas(run, "doc_id long, host string, page_score double")


def spam_pages(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id) of the pages whose smoothed score reaches ``threshold``."""
    return score_pages(documents).filter(F.col("score") >= threshold).select("doc_id").distinct()
