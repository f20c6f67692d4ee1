import random

import pytest

from chronotier.llm import stuffing

NOUNS = ["kettle", "tent", "lamp", "blender", "backpack", "toaster"]
SUBJECTS, VERBS, ENDS = ["my sister", "the courier", "our neighbour", "the old shop", "a friend of mine"], ["wanted to keep", "gladly bought", "sent back", "could not open", "has often used"], ["after three long weeks", "before we moved away", "because it was so loud", "and that was fine", "which I can live with"]


def review(rnd):
    return " ".join(f"{rnd.choice(SUBJECTS).capitalize()} {rnd.choice(VERBS)} the {rnd.choice(NOUNS)} {rnd.choice(ENDS)}." for _ in range(rnd.randint(3, 9)))


def stuffed(rnd):
    noun, keys = rnd.choice(NOUNS), ["buy", "cheap", "sale", "online", "best", "discount", "coupon"]
    kind = rnd.randrange(4)
    if kind == 0:
        return " ".join(rnd.choice([noun, rnd.choice(keys)]) for _ in range(60))
    if kind == 1:
        return " ".join(f"#{rnd.choice(keys)}_{noun}" for _ in range(30))
    if kind == 2:
        return " ".join(f"[{rnd.choice(keys)} {noun}](http://shop{rnd.randrange(99)}.example/{noun})" for _ in range(12))
    return " | ".join(f"Brand {rnd.choice(NOUNS)} X{rnd.randrange(999)}" for _ in range(20))


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(4)
    rows, label = [], {}
    for i in range(700):
        bad = i % 7 == 0
        rows.append((i, stuffed(rnd) if bad else review(rnd), rnd.choice(["a", "b", None]), "x"))
        label[i] = bad
    special = {
        1000: (review(rnd) + " #sale #kettle", False), 1001: (stuffed(random.Random(9)), True), 1002: (None, False), 1003: ("", False), 1004: (" \n ", False), 1005: ("+1", False),
        1006: ("good good good " + review(rnd), False), 1007: ((r := review(rnd)) + "\n" + r, False), 1008: ("My sister gladly bought the lamp. " + "buy lamp cheap lamp sale lamp online lamp " * 8, True),
        1009: ("b u y   l a m p   c h e a p   l a m p   s a l e   " * 4, True), 1010: ("x" * 30_000, False),
    }
    for k, (t, bad) in special.items():
        rows.append((k, t, "a", "x"))
        label[k] = bad
    rows += [(None, "buy cheap lamp " * 20, "a", "x"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, share string")  # a clashing name
    return stuffing.score_pages(df).collect(), label, len(rows)


def test_pages(scored):
    out, label, n = scored
    assert len(out) == n
    wrong = [r["doc_id"] for r in out if r["doc_id"] is not None and r["stuffed"] != label[r["doc_id"]]]
    assert len([i for i in wrong if i < 1000]) <= 3
    assert not [i for i in wrong if i >= 1000]


def test_shares_and_hosts(scored):
    out, label, _ = scored
    assert all(0 <= r["share"] <= 1 for r in out)
    assert all(0.05 < r["host_rate"] < 0.4 for r in out)
    assert {r["source"] for r in out} == {"a", "b", ""}


def test_short_pages_of_links_or_tags_alone(spark):
    rnd = random.Random(5)
    rows = [(i, stuffed(rnd) if i % 7 == 0 else review(rnd), "a") for i in range(700)]
    bad = ["#sale #shop #cheap", "http://shop7.example/lamp", "[buy lamp](http://shop7.example/lamp)", "#cheap_lamp #sale_lamp"]
    good = ["Too loud", "Good lamp.", "Very good lamp, my sister wanted it #lamp", "Works fine. #lamp", "Verdict:great", "cheap lamp", "My sister gladly bought it, see lamp.example", "Good lamp, see https://shop7.example/lamp/blue"]
    rows += [(1000 + i, t, "a") for i, t in enumerate(bad + good)]
    out = stuffing.score_pages(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id >= 1000").collect()
    assert {r["doc_id"] for r in out if r["stuffed"]} == {1000 + i for i in range(len(bad))}


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, source string"
    assert stuffing.score_pages(spark.createDataFrame([], schema)).count() == 0
    out = stuffing.score_pages(spark.createDataFrame([(1, None, None), (2, "short", "a")], schema)).collect()
    assert [r["stuffed"] for r in out] == [False, False]


def test_spelling_is_undone():
    assert stuffing.clean("b u y   c h e a p   l a m p   n o w") == "buy cheap lamp now"
    assert stuffing.clean("ｂｕｙ​ <b>now</b>") == "buy  now "
    assert stuffing.words("Buy NOW 12") == ["buy", "now", "12"]
    assert stuffing.words("便宜背包") == ["便宜", "宜背", "背包"]


def test_weak_labels():
    label = lambda t: (lambda got: None if got[0] < 0 else got[0])(stuffing.read_page(t))
    assert label("buy lamp cheap lamp " * 10) == 1
    assert label(review(random.Random(1))) in (0, None)
    assert label("Too loud") == 0 == label("Verdict:great")
    assert label("#sale #shop #cheap") == 1 == label("http://shop7.example/lamp")
    assert label("buycheaplamp" * 40) == 1 and label("s" + "o" * 300) != 1
    assert label("The cable is fine. My sister wanted one at once, so we ordered it.") == 0


def test_links_and_runs_are_chunks_and_nothing_is_cut_off():
    t = 'See <a href="http://shop7.example/lamp">this lamp</a> and ' + "buycheaplamp" * 40 + " now."
    pieces = stuffing.items(stuffing.clean(t))
    assert [k for k, _ in pieces] == ["text", "link", "text", "run", "text"] and "".join(p for _, p in pieces) == stuffing.clean(t)
    assert pieces[1][1] == "[this lamp](http://shop7.example/lamp)"
    assert stuffing.words(pieces[3][1]) == ["buycheaplamp" * 40]
    assert stuffing.words("donaudampfschifffahrtsgesellschaft") == ["donaudampfschifffahrtsgesellschaft"]
    assert stuffing.repetition("buycheaplamp" * 40) > 0.9 and stuffing.repetition("so" * 200) == 0
    label, chars, n_words, ids, lengths, own = stuffing.read_page(t)
    assert len(chars) == len(n_words) == len(own) // len(stuffing.OWN) and sum(n_words) == len(ids) == len(lengths)
    assert stuffing.read_page("")[1:] == ([], [], [], [], [])


def test_the_host_decides_what_is_in_doubt(spark):
    rows = [(i, "farm", 1.0, 0.0) for i in range(300)] + [(1000 + i, "clean", 0.0, 0.0) for i in range(300)]
    rows += [(5000, "farm", 0.4, 0.8), (5001, "clean", 0.6, 0.8), (5002, "farm", 0.4, 0.0), (5003, "clean", 0.6, 0.0), (5004, "new", 1.0, 0.1), (5005, "farm", 0.02, 0.3)]
    shares = spark.createDataFrame(rows, "doc_id long, source string, share double, doubt double")
    out = {r["doc_id"]: r for r in stuffing.smooth_by_host(shares).where("doc_id >= 5000").collect()}
    assert {i for i, r in out.items() if r["stuffed"]} == {5000, 5003, 5004}
    alone = {r["doc_id"] for r in stuffing.smooth_by_host(shares, host_pull=0.0).where("stuffed AND doc_id >= 5000").collect()}
    assert alone == {5001, 5003, 5004}  # by their shares alone the doubtful pages come out the other way round
    whole = 303 / 606
    assert out[5004]["host_rate"] == pytest.approx(whole)  # without the page itself its host has no page
    assert out[5000]["host_rate"] == pytest.approx((300 + 50 * whole) / 352)
