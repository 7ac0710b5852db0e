"""Readers and writers on files written here."""

import json

from pyspark.sql import functions as F

from rostrum.operators import meetings as me
from rostrum.sources import readers as rd
from rostrum.sources import writers as wr


def _lecture(root):
    d = root / "spk" / "course" / "01"
    d.mkdir(parents=True)
    (d / "vid_transcripts.csv").write_text("Word,Start,End\nhello,0.0,0.4\n ,1,2\nworld,x,\n\"a,b\",2.0,2.5\n")
    (d / "segments.txt").write_text("2.5\n\nbad\n5.5\n")
    head = "level,page_num,block_num,par_num,line_num,word_num,left,top,width,height,conf,text\n"
    (d / "slide_000_ocr.csv").write_text(head + "5,1,1,1,1,2,0,0,0,0,90,slide\n5,1,1,1,1,1,0,0,0,0,,intro\n")
    return d


def test_lecture_directory(spark, tmp_path):
    _lecture(tmp_path)
    root = str(tmp_path)
    cat = rd.discover_lectures(spark, root).collect()
    assert [(r.lecture_key, r.video_id) for r in cat] == [("spk/course/01", "vid")]
    words = rd.read_words(spark, root).orderBy("ord").collect()
    assert [(r.Word, r.Start) for r in words if (r.Word or "").strip()] == [("hello", "0.0"), ("world", "x"), ("a,b", "2.0")]
    assert [r.end for r in rd.read_slide_ends(spark, root).orderBy("slide_index").collect()] == [2.5, 5.5]
    assert rd.read_slide_lines(spark, root).where("end is null").count() == 1
    from rostrum.operators.slides import ocr_slide_texts

    text = ocr_slide_texts(rd.read_ocr_tokens(spark, root), min_conf=60).first()
    assert (text.slide_index, text.ocr_text) == (0, "intro slide")


def test_question_files(spark, tmp_path):
    p = tmp_path / "range.csv"
    p.write_text("question,lecture_key,answer_timestamps,answer_text,question_type\n"
                 "q1,a/b/c,1-2 | 3-4,\"x, y\",summary\nq2,a/b/c,1-2,first, second,function\nq3,a/b/c,1-2,t,,process\n"
                 "q4,a/b/c,1-2,\"a \"\"b\"\", c\",d,,,,,,,,,,,,,summary\nq5,a/b/c,1-2,\"two\nlines, one\",cell,function\n")
    got = {r.question: r for r in rd.read_range_questions(spark, str(p)).collect()}
    assert (got["q1"].answer_text, got["q1"].question_type) == ("x, y", "summary")
    assert (got["q2"].answer_text, got["q2"].question_type) == ("first,second", "function")
    assert got["q3"].question_type == "process" and got["q3"].row_index == 3
    assert (got["q4"].answer_text, got["q4"].question_type) == ('a "b", c,d', "summary")
    assert (got["q5"].answer_text, got["q5"].question_type) == ("two\nlines, one,cell", "function")
    p = tmp_path / "ts.csv"
    p.write_text("url,id,question,answer,timestamp\nu,v,q,a,1:02\nu,,q,a,1:00:01\nu,v,q,a,zz\n")
    rows = rd.read_timestamp_questions(spark, str(p), "test").orderBy("row_index").collect()
    assert [(r.example_id, r.timestamp_seconds, r.error) for r in rows] == [
        ("test-000001", 62, None), ("test-000002", 3601, "missing_url_or_id"), ("test-000003", None, "bad_timestamp")]
    p = tmp_path / "ids.csv"
    p.write_text("question,lecture_key,asr_segment_ids,ocr_slide_indices\nq, a/b/c,\"[1, 2]\",7\n")
    r = rd.read_id_questions(spark, str(p)).first()
    assert (r.lecture_key, r.asr_segment_ids, r.ocr_slide_indices) == ("a/b/c", [1, 2], [7])


def test_dumps_and_lines(spark, tmp_path):
    p = tmp_path / "dump.json"
    seg = lambda i, t: {"segment_id": i, "start": 0.0, "end": 1.0, "text": t}
    p.write_text(json.dumps([{"lecture_key": "k", "asr_segments": [seg(1, "a"), seg(1, "b"), seg(2, "c")]}]))
    rows = rd.read_segment_dump(spark, str(p))
    assert sorted((r.segment_id, r.text) for r in rows.collect()) == [(1, "b"), (2, "c")]
    again = wr.segment_dump(rows)
    wr.write_jsonl(again, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert [s.segment_id for s in back.asr_segments] == [1, 2]
    assert rd.read_jsonl(spark, str(tmp_path / "absent.jsonl"), "a string").count() == 0
    ends = spark.createDataFrame([("k", 0, 1.0), ("k", 1, 0.5), ("k", 2, 2.25)], "lecture_key string, slide_index long, end double")
    wr.write_slide_ends(ends, str(tmp_path / "ends"))
    text = "".join(f.read_text() for f in (tmp_path / "ends" / "lecture_key=k").glob("part-*"))
    assert text == "1.0000\n2.2500\n"
    docs = spark.createDataFrame([("k", 1, "*L", 0.0, 2.0, 3, "body")],
                                 "lecture_key string, segment_id int, tree_path string, start double, end double, n_utterances int, text string")
    wr.write_segment_documents(docs, str(tmp_path / "docs"))
    assert "Duration: 2.00s" in next((tmp_path / "docs" / "lecture_key=k" / "segment_id=1").glob("part-*")).read_text()
    wr.write_csv(docs, str(tmp_path / "csv"), ["text", "lecture_key"], single=True)
    assert next((tmp_path / "csv").glob("part-*")).read_text().splitlines() == ["text,lecture_key", "body,k"]
    wr.write_run_summary(docs.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "run"))
    assert json.loads(next((tmp_path / "run").glob("part-*")).read_text()) == {"n": 1}


NS = 'xmlns:nite="http://nite.sourceforge.net/"'


def test_meeting_files(spark, tmp_path):
    (tmp_path / "M1.A.words.xml").write_text(
        f'<?xml version="1.0"?>\n<nite:root nite:id="r" {NS}>\n<w nite:id="w0" starttime="0.0" endtime="0.5" c="W">Well</w>\n'
        '<w nite:id="w1" starttime="0.5" endtime="0.5" c="CM">,</w>\n<vocalsound nite:id="v2" starttime="0.6" endtime="0.9"/>\n'
        '<w nite:id="w3" starttime="1.0" endtime="1.2" c="W">R&amp;D</w>\n<w nite:id="w4" c=".">.</w>\n</nite:root>')
    (tmp_path / "M1.A.segs.xml").write_text(
        f'<nite:root {NS}><segment nite:id="M1.A.9" type="supersegment"><segment nite:id="M1.A.10" starttime="0.0" endtime="2.0">'
        '<nite:child href="M1.A.words.xml#id(w0)..id(w4)"/></segment></segment></nite:root>')
    (tmp_path / "M1.topic.xml").write_text(
        f'<nite:root {NS}><topic nite:id="t1"><nite:child href="M1.A.segs.xml#id(M1.A.10)"/>'
        '<topic nite:id="t2"><nite:child href="M1.A.segs.xml#id(M1.A.10)..id(M1.A.12)"/></topic></topic></nite:root>')
    root = str(tmp_path)
    words = rd.read_meeting_words(spark, root)
    assert [(r.pos, r.word_key, r.text) for r in words.orderBy("pos").collect()] == [
        (0, "w0", "Well"), (1, "w1", ","), (2, "v2", None), (3, "w3", "R&D"), (4, "w4", ".")]
    segs = rd.read_meeting_segments(spark, root)
    assert [(r.utt_key, r.start_key, r.end_key) for r in segs.collect()] == [("M1.A.10", "w0", "w4")]
    spaced = me.classify_words(words)
    placed = words.drop("cls", "text", "start", "end").join(spaced.drop("word_key"), ["meeting", "speaker", "pos"], "left")
    utt = me.join_spaced(me.words_in_ranges(segs.drop("start", "end"), placed), ["meeting", "speaker", "utt_key"]).first()
    assert utt.text == "Well, R&D."
    topics = rd.read_topic_tree(spark, root).orderBy("path").collect()
    assert [(r.path, r.is_leaf) for r in topics] == [("*", False), ("*.0", False), ("*.0.0", True), ("*.0.1", True)]
    (tmp_path / "M2.topic.xml").write_text(f'<nite:root {NS}><topic nite:id="t1"/><topic nite:id="t2"><nite:child href="x#id(a)"/></topic></nite:root>')
    (tmp_path / "M3.topic.xml").write_text("no xml")
    topics = rd.read_topic_tree(spark, root).where("meeting <> 'M1'").orderBy("meeting", "path").collect()
    assert [(r.meeting, r.path, r.is_leaf, r.error) for r in topics] == [
        ("M2", "*", False, None), ("M2", "*.0", True, "empty_topic"), ("M2", "*.1", True, None), ("M3", "*", True, "unreadable")]
    seg = spark.createDataFrame([("M1", "A", "*.0.1", "M1.A.segs.xml#id(M1.A.999)..id(M1.A.1,001)")],
                                "meeting string, speaker string, path string, href string")
    have = spark.createDataFrame([("M1", "A", k) for k in ("M1.A.999", "M1.A.1,001", "M1.A.5")], "meeting string, speaker string, utt_key string")
    assert [r.utt_key for r in me.utterances_of(seg, have).orderBy("ord").collect()] == ["M1.A.999", "M1.A.1,001"]


def test_meeting_words_decode_references_and_encodings(spark, tmp_path):
    from rostrum.sources.readers import read_meeting_words

    body = '<?xml version="1.0" encoding="ISO-8859-1"?>\n<nite:root><w nite:id="A.1" starttime="0" endtime="1">It&#39;s caf\xe9 &#xe9; &amp;#39;</w></nite:root>'
    (tmp_path / "M1.A.words.xml").write_bytes(body.encode("latin-1"))
    assert [r.text for r in read_meeting_words(spark, str(tmp_path)).collect()] == ["It's caf\xe9 \xe9 &#39;"]
