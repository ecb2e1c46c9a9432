"""Stems, the log of versions, and the index that takes and gives up items."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from fathom.functions import stem, text
from fathom.operators import segments, sparse
from fathom.session import ship
from fathom.sources.commits import CommitLog, Conflict

#: Words and their stems from the published description of the stemmer, and words that its rules name.
STEMS = dict(
    x.split(":")
    for x in """consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist consistent:consist
consistently:consist consisting:consist consists:consist consolation:consol consolations:consol consolatory:consolatori console:consol consoled:consol consoles:consol
consolidate:consolid consolidated:consolid consolidating:consolid consoling:consol consolingly:consol consols:consol consonant:conson consort:consort consorted:consort
consorting:consort conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci conspirator:conspir conspirators:conspir conspire:conspir conspired:conspir
conspiring:conspir constable:constabl constables:constabl constance:constanc constancy:constanc constant:constant knack:knack knackeries:knackeri knacks:knack knag:knag
knave:knave knaves:knave knavish:knavish kneaded:knead kneading:knead knee:knee kneel:kneel kneeled:kneel kneeling:kneel kneels:kneel knees:knee knell:knell knelt:knelt
knew:knew knick:knick knif:knif knife:knife knight:knight knightly:knight knights:knight knit:knit knits:knit knitted:knit knitting:knit knives:knive knob:knob knobs:knob
knock:knock knocked:knock knocker:knocker knockers:knocker knocking:knock knocks:knock knopp:knopp knot:knot knots:knot ties:tie cries:cri gas:gas this:this gaps:gap
kiwis:kiwi luxuriate:luxuri hopped:hop hopping:hop hoping:hope hoped:hope cry:cri by:by say:say enjoyed:enjoy generate:generat generously:generous communal:communal
skies:sky dying:die news:news inning:inning proceed:proceed proceeding:proceed singly:singl relational:relat rationalism:ration geologi:geolog quickly:quick
bed:bed shed:shed yellow:yellow youth:youth agreed:agre feed:feed rolling:roll controlling:control abilities:abil nationality:nation hopefulness:hope is:is""".split()
)


@pytest.mark.parametrize("word", sorted(STEMS))
def test_published_stems(word):
    assert stem.english(word) == STEMS[word]


def test_stems_in_columns(spark):
    ship(spark)
    rows = spark.createDataFrame([("The Knights, kneeling — and 5 Äpfel's x",), (None,), ("",)], "t string")
    got = rows.select(text.search_tokens(F.col("t")).alias("a"), text.search_tokens(F.col("t"), stemmer=None).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(["knight", "kneel", "äpfel"], ["knights", "kneeling", "äpfel"]), (None, None), ([], [])]
    assert [r.s for r in rows.select(stem.stemmed(F.col("t")).alias("s")).collect()][1:] == [None, ""]
    with pytest.raises(ValueError):
        stem.stemmed(F.col("t"), "klingon")


@pytest.mark.parametrize("local", [True, False])
def test_one_writer_puts_a_version(spark, tmp_path, local):
    log = CommitLog(spark, str(tmp_path))
    assert log.state() == (0, {})
    log._local = local
    assert log.put(1, {"by": "a"}) and not log.put(1, {"by": "b"})
    assert log.state() == (1, {"by": "a"}) and log.version() == 1
    assert log.put(2, {"by": "ß"}) and log.state() == (2, {"by": "ß"}) and log.state(1) == (1, {"by": "a"})


def test_writers_at_once_lose_nothing(spark, tmp_path):
    def work(name):
        log = CommitLog(spark, str(tmp_path))
        for k in range(5):
            log.commit(lambda old: {"done": [*old.get("done", []), f"{name}{k}"]}, 200)

    threads = [threading.Thread(target=work, args=(n,)) for n in "abcd"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = CommitLog(spark, str(tmp_path))
    assert log.version() == 20 and sorted(log.state()[1]["done"]) == sorted(f"{n}{k}" for n in "abcd" for k in range(5))
    assert log.commit(lambda old: None) == log.state()


def test_a_writer_that_is_always_late_gives_up(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))

    def late(old):
        log.put(log.version() + 1, {})
        return {}

    with pytest.raises(Conflict):
        log.commit(late, 3)


WORDS = "alpha beta gamma delta running runs ran the of".split()


def scored(index, terms=("alpha", "run", "gamma")):
    return [] if index is None else sorted((r.kb, r.item, r.score) for r in sparse.scores(index, list(terms)).collect())


def sums(index):
    return sorted((r.kb, r["item_count"], r.tokens) for r in index.totals.collect())


@pytest.mark.parametrize("stemmer, stop", [(None, None), ("english", ["the", "of"])])
def test_changes_equal_a_fresh_index(spark, tmp_path, monkeypatch, stemmer, stop):
    """Random changes, with merges of every kind: scores and totals are those of an index built of what is left."""
    monkeypatch.setattr(segments, "FANOUT", 2)
    rng = random.Random(9)
    index = segments.SegmentedIndex(spark, str(tmp_path / "index"), stemmer=stemmer, stop_words=stop)
    live, before = {}, []
    for step in range(6):
        if step % 3 != 2:
            new = {rng.randrange(40): (" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9))) or None, rng.choice("xy")) for _ in range(6)}
            index.add(spark.createDataFrame([(k, *v) for k, v in new.items()], "id long, body string, kb string"), "id", "body", "kb")
            live |= new
        else:
            gone = rng.sample(sorted(live), 4) + [999]
            index.remove(spark.createDataFrame([(k,) for k in gone], "item long"))
            live = {k: v for k, v in live.items() if k not in gone}
        if step in (1, 5):
            docs = spark.createDataFrame([(k, *v) for k, v in live.items()], "id long, body string, kb string")
            fresh = sparse.index_of(sparse.postings(docs, "id", "body", "kb", stemmer, stop))
            assert scored(index.open()) == scored(fresh) and sums(index.open()) == sums(fresh)
            before.append((index.log.version(), scored(index.open())))
    assert index.log.state()[1]["segments"]
    index.merge(everything=True)
    state = index.log.state()[1]
    assert len(state["segments"]) == 1 and not state["tombstones"] and not state["dead"] and len(state["changes"]) == 1
    assert scored(index.open()) == before[-1][1] and sums(index.open()) == sums(fresh)
    assert [scored(index.open(v)) for v, _ in before] == [s for _, s in before], "a version stays what it was"


def test_an_index_of_nothing(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "a"), item="string")
    none = spark.createDataFrame([], "id string, body string")
    assert index.open() is None and index.remove(none.select(F.col("id").alias("item"))) == 0 and index.add(none, "id", "body") == 0 and index.merge() == 0
    one = spark.createDataFrame([("a", "alpha")], "id string, body string")
    assert index.add(one, "id", "body") == 1
    index.remove(one.select(F.col("id").alias("item")))
    assert scored(index.open()) == [] and sums(index.open()) == []


def test_a_change_writes_its_own_segment_and_a_search_reads_its_buckets(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame([(k, f"word{k} alpha") for k in range(50)], "id long, body string")
    index.add(docs, "id", "body")
    first = index.log.state()[1]["segments"]
    index.add(spark.createDataFrame([(100, "alpha again")], "id long, body string"), "id", "body")
    assert [s["path"] for s in index.log.state()[1]["segments"]][:1] == [s["path"] for s in first]
    plan = sparse.search(index.open(), ["alpha"], 3)._jdf.queryExecution().executedPlan().toString()
    read = [x for x in plan.split("\n") if "FileScan" in x and "term" in x.split("]")[0]]
    assert read and all("bucket" in x.split("PartitionFilters")[1] for x in read)


def test_builders_at_once_agree(spark, tmp_path):
    docs = spark.createDataFrame([(k, "alpha beta") for k in range(5)], "id long, body string")
    indexes = [segments.SegmentedIndex(spark, str(tmp_path / "b")) for _ in range(3)]
    threads = [threading.Thread(target=i.build, args=(docs, "id", "body")) for i in indexes]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert indexes[0].log.version() == 1 and sums(indexes[0].open()) == [("", 5, 10)]
    assert len([p for p in (tmp_path / "b").iterdir() if p.name.startswith("segment")]) == 1


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("stemmer, stop", [(None, None), ("english", ["the"])])
def test_postings_are_counted_where_texts_are_read(spark, repeated, stemmer, stop):
    """No word is shuffled to be counted; the rows of one item meet, as far as they have one base and length."""
    rows = [(1, "a", "The fox, the Fox and foxes"), (2, "a", None), (3, None, ""), (4, "b", "x"), (None, "b", "fox Straße ÄÖ ÄÖ")]
    rows += [(1, "a", "A fox is the six word fox")] * 2 if repeated else []
    docs = spark.createDataFrame(rows, "id long, kb string, body string")
    found = sparse.postings(docs, "id", "body", "kb", stemmer, stop)
    want = {}
    for item, kb, body in rows:
        terms = sparse.regex.findall(text.WORDS, (body or "").lower())
        terms = terms if stop is None else [stem.english(w) for w in terms if len(w) > 1 and w not in stop]
        for term in [*terms, ""]:
            key = (kb, item, term, len(terms))
            want[key] = want.get(key, 0) + 1
    got = found.collect()
    assert {(r.kb, r.item, r.term, r.n): r.tf for r in got} == want and len(got) == len(want)
    assert all(r.bucket == sparse.bucket_of(r.term) for r in got)
    assert repeated or "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_an_index_keep_their_size(spark, tmp_path, monkeypatch):
    """Larger texts are written in more parts of each bucket, none of which holds all of a term; a merge keeps the parts."""
    docs = spark.range(400).selectExpr("id", "concat('fox ', id) t")
    monkeypatch.setattr(sparse, "PART_BYTES", 1000)
    assert sparse.parts_of(docs, "t") == 3 and sparse.parts_of(docs.where("false"), "t") == 1
    index = segments.SegmentedIndex(spark, str(tmp_path))
    index.build(docs, "id", "t")
    index.merge(everything=True)
    state = index.log.state()[1]
    assert [s["parts"] for s in state["segments"]] == [3]
    fox = index.open().postings.where("term = 'fox'")
    files = fox.groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) == 3 and sum(f["count"] for f in files) == 400 and max(f["count"] for f in files) < 200


def test_words_are_counted_in_bounded_steps(monkeypatch):
    """A batch is counted in steps of so many words; a text with more is one step, and a stem is told once a step."""
    monkeypatch.setattr(sparse, "WORDS_AT_ONCE", 3)
    told = []
    monkeypatch.setitem(stem.STEMMERS, "probe", lambda w: told.append(w) or w[:3])
    lists = [["foxes", "fox"], ["fox"], [], ["a", "b", "a", "a", "b"], ["foxy"]]
    batch = sparse.pa.RecordBatch.from_pydict({"kb": [None, "", "x", "x", "x"], "item": [1, 2, 3, None, 5], "w": sparse.pa.array(lists, sparse.pa.list_(sparse.pa.string()))})
    found = [b.to_pylist() for b in sparse._counted("probe")(iter([batch]))]
    assert [len(b) for b in found] == [5, 3, 2] and told == ["foxes", "fox", "a", "b", "foxy"]
    assert {(r["kb"], r["item"], r["n"], r["term"], r["tf"]) for b in found for r in b} == {
        (None, 1, 2, "fox", 2), (None, 1, 2, "", 1), ("", 2, 1, "fox", 1), ("", 2, 1, "", 1), ("x", 3, 0, "", 1),
        ("x", None, 5, "a", 3), ("x", None, 5, "b", 2), ("x", None, 5, "", 1), ("x", 5, 1, "fox", 1), ("x", 5, 1, "", 1),
    }
