"""Files in and out."""

import glob
import hashlib
import json
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from leadspan.functions.normalize import approx_tokens, quarter_tokens
from leadspan.operators.chunks import SPACE_CHARS, chunk_documents
from leadspan.operators.memory import read_index, write_index
from leadspan.sinks import exports as X
from leadspan.sources import files as SF
from leadspan.sources.feeds import parse_feeds
from leadspan.sources.html import html_to_markdown
from tests.conftest import SF as DATA


def test_csv_import(spark, tmp_path):
    p = tmp_path / "leads.csv"
    p.write_text('email, name ,company\na@x.com,"Doe, ""J"" Ann", Acme \nb@x.com\n')
    rows = [tuple(r) for r in SF.read_csv_leads(spark, str(p)).collect()]
    assert rows == [("a@x.com", 'Doe, "J" Ann', "Acme"), ("b@x.com", "", "")]


def test_json_imports(spark, tmp_path):
    one, many, wrapped = tmp_path / "one.json", tmp_path / "many.json", tmp_path / "w.json"
    one.write_text(json.dumps({"a": 1}))
    many.write_text(json.dumps([{"a": 1}, {"a": 2}]))
    wrapped.write_text(json.dumps({"visitors": [{"firstName": "Ann", "title": "CEO", "profileUrl": "u"}, {"first_name": "Bob"}]}))
    assert SF.read_json_leads(spark, str(one)).count() == 1 and SF.read_json_leads(spark, str(many)).count() == 2
    rows = SF.read_visitors(spark, str(wrapped)).orderBy("first_name").collect()
    assert [(r.first_name, r.headline, r.linkedin_url, r.company, r.source) for r in rows] == [("Ann", "CEO", "u", "", "profile_visitor"), ("Bob", "", "", "", "profile_visitor")]


def test_suppression_file_keeps_the_email(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("Email,First_Name,Last_Name,LinkedIn\nx@y.com,Ann,Lee,\n,Bob,Ray,\n,Cy,Day,https://l/in/cy\n")
    rows = {r.name: r for r in SF.load_suppression_csv(spark, str(p)).collect()}
    assert set(rows) == {"Ann Lee", "Cy Day"} and rows["Ann Lee"].email == "x@y.com" and rows["Cy Day"].provider_id == "https://l/in/cy"


def test_review_import(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"leads": [{"name": "A", "score": 96, "id": "1"}, {"title": "T", "company": "C"}], "other": [{"name": "Z", "score": 80}]}))
    rows = SF.read_review_items(spark, str(p)).orderBy("title").collect()
    assert [(r.title, r.priority, r.description) for r in rows] == [("A", "high", ""), ("T", "low", "C — T")]
    assert SF.read_review_items(spark, str(p), "other").first().priority == "normal"


def test_markdown_folder(spark, tmp_path):
    for name in ("notes/a.md", "notes/deep/b.md", "notes/c.txt", "other/d.md"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"# {name}")
    paths = lambda *g: sorted(r.path for r in SF.read_markdown(spark, str(tmp_path), g).collect())
    assert paths("notes/*.md") == ["notes/a.md"] and paths("notes/**/*.md") == ["notes/a.md", "notes/deep/b.md"] and paths("other/d.md") == ["other/d.md"]


def test_exports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"x', None, 1)], "x string, y string, z string, n int")
    X.export_csv(df, str(tmp_path / "c"), ["x", "y", "z", "gone"])
    row = SF.read_csv_leads(spark, str(tmp_path / "c")).first()
    assert tuple(row) == ("a,b", 'q"x', "", "") and row.asDict().keys() == {"x", "y", "z", "gone"}
    X.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().n == 1
    X.write_result_set(df, "s1", str(tmp_path / "r"), ["n"])
    saved = spark.read.parquet(str(tmp_path / "r")).first()
    assert saved.row_index == 0 and json.loads(saved.data) == {"x": "a,b", "y": 'q"x', "n": 1} and saved.result_set_id == "s1"
    assert X.column_labels(df.select(F.lit(1).alias("first_name")))[0]["label"] == "First Name"


def test_batches_are_retried(spark, tmp_path):
    folder = str(tmp_path)

    def send(batch):
        import os
        import uuid

        mark = f"{folder}/{batch[0]['id']}.failed"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("try again")
        with open(f"{folder}/{uuid.uuid4()}.sent", "w") as f:
            f.write(",".join(str(r["id"]) for r in batch))

    X.foreach_batch_sink(spark.range(0, 23, 1, 2), send, size=5, pause=0.01)
    sent = [p.read_text().split(",") for p in tmp_path.glob("*.sent")]
    assert sorted(int(x) for b in sent for x in b) == list(range(23)) and max(map(len, sent)) == 5


def test_feed_documents(spark):
    rss = '<?xml version="1.0"?><rss><channel><item><title>A</title><link>https://a</link><pubDate>Thu, 18 Jun 2026 10:00:00 GMT</pubDate></item><item><title>B</title><link>https://b</link><guid>gb</guid><pubDate>Mon, 15 Jun 2026 08:00:00 +0200</pubDate></item></channel></rss>'
    atom = '<feed><entry><title>C</title><link rel="self" href="https://s"/><link href="https://c"/><id>i</id><published>2026-06-18T10:00:00Z</published></entry></feed>'
    rows = {r.title: r for r in parse_feeds(spark.createDataFrame([("r", rss), ("a", atom), ("x", "not xml"), ("y", "<rss><bad")], "source_key string, xml string")).collect()}
    assert set(rows) == {"A", "B", "C"} and rows["A"].guid == "https://a" and rows["B"].guid == "gb" and rows["C"].link == "https://c"
    assert str(rows["B"].published_at) == "2026-06-15 06:00:00"


def test_html_cap_is_only_on_request(spark):
    df = spark.createDataFrame([("<p>" + "x" * 60000 + "</p>",)], "h string")
    whole, cut = df.select(html_to_markdown(F.col("h")), html_to_markdown(F.col("h"), 50000)).first()
    assert len(whole) == 60000 and cut.endswith("[Content truncated at 50,000 characters]")


def tokens_in(s):
    return math.ceil(len(s.encode("utf-16-le")) // 2 * 0.28)


def plain_chunks(text, low, high):
    """Chunks from the rules: the end of each is searched for from its beginning."""
    lines = []
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        if tokens_in(line) <= high:
            lines.append(line)
            continue
        parts = re.findall(f"[{SPACE_CHARS}]+|[^{SPACE_CHARS}]+", line)
        while parts:
            n = 1
            while n < len(parts) and tokens_in("".join(parts[: n + 1])) <= high:
                n += 1
            lines.append("".join(parts[:n]))
            parts = parts[n:]
            if parts and not parts[0].strip(SPACE_CHARS):
                parts = parts[1:]
    heads = [re.fullmatch(f"(#{{1,6}})[{SPACE_CHARS}]+([^\n\r\u2028\u2029]*)", x) for x in lines]
    out, begin = [], 0
    while begin < len(lines):
        sizes = [tokens_in(x) + 1 for x in lines[begin:]]
        ends = [i for i in range(1, len(sizes)) if sum(sizes[:i]) >= high or (heads[begin + i] and len(heads[begin + i][1]) <= 2 and sum(sizes[:i]) >= low)]
        end = begin + (ends[0] if ends else len(sizes))
        path = []
        for h in filter(None, heads[:end]):
            path = [*path, *[None] * 6][: len(h[1]) - 1] + [h[2].strip(SPACE_CHARS)]
        body = "\n".join(lines[begin:end]).strip(SPACE_CHARS)
        if body:
            out.append((len(out), body, path, hashlib.sha256(re.sub(f"[{SPACE_CHARS}]+", " ", body).strip().encode()).hexdigest(), begin, end - 1, sum(sizes[: end - begin])))
        begin = end
    return out


def test_chunks(spark):
    body = "word " * 400  # 560 tokens
    texts = [
        "", "  \n ", None, f"# One\n{body}\n## Two\nshort\n### Three\ntail", "# A\nx\n## B\ny", "word " * 2000, "### deep", "#no heading\n####### seven\n#\tTab\r\nx", "\n" * 2000 + "# late",
        "😀 " * 3000, "x" * 5000 + " y " + "z" * 4000, f"{body}\n\n# H\n{body}\n{body}\n## I\n### J\n# K", "   " * 1200 + "a",
    ]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for low, high in ((500, 800), (20, 60)):
        got = {}
        for r in chunk_documents(rows, "i", "t", low, high).collect():
            got.setdefault(r.i, []).append(tuple(r)[1:])
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == plain_chunks(t, low, high), (i, low)
    first, second = plain_chunks(texts[3], 500, 800)
    assert first[2] == ["One"] and first[4:6] == (0, 1) and second[1] == "## Two\nshort\n### Three\ntail" and second[2] == ["One", "Two", "Three"]


def test_characters_beyond_the_basic_plane_count_twice(spark):
    row = spark.createDataFrame([("😀" * 100,)], "t string").select(approx_tokens(F.col("t")), quarter_tokens(F.col("t"))).first()
    assert tuple(row) == (57, 50)


class Outbox:
    """Staged batches are files of an attempt; published ones are moved to where the receiver looks."""

    def __init__(self, folder, fail=False):
        self.folder, self.fail = str(folder), fail
        for name in ("staged", "sent"):
            os.makedirs(f"{self.folder}/{name}", exist_ok=True)

    def stage(self, attempt, number, batch):
        with open(f"{self.folder}/staged/{attempt}-{number}", "w") as f:
            json.dump(batch, f)
        if self.fail and any(r["id"] == 40 for r in batch):
            raise ValueError("receiver is down")

    def publish(self, attempts):
        for name in os.listdir(f"{self.folder}/staged"):
            if name.split("-")[0] in attempts:
                os.rename(f"{self.folder}/staged/{name}", f"{self.folder}/sent/{name}")

    def discard(self, attempts):
        for name in os.listdir(f"{self.folder}/staged"):
            if name.split("-")[0] in attempts:
                os.remove(f"{self.folder}/staged/{name}")

    def sent(self):
        return [json.load(open(f"{self.folder}/sent/{n}")) for n in os.listdir(f"{self.folder}/sent")]


def test_batches_are_published_once(spark, tmp_path):
    X.write_batches(spark.range(0, 53, 1, 3), box := Outbox(tmp_path / "a"), 10)
    assert sorted(r["id"] for b in box.sent() for r in b) == list(range(53)) and max(map(len, box.sent())) == 10
    # a task that fails after it put up some batches: the job fails and nothing of it is given out
    broken = Outbox(tmp_path / "b", fail=True)
    with pytest.raises(Exception, match="receiver is down"):
        X.write_batches(spark.range(0, 53, 1, 3), broken, 10)
    assert broken.sent() == [] and os.listdir(f"{broken.folder}/staged")
    # an attempt that was doubled: Spark commits one message of the partition, the other attempt stays unpublished
    box = Outbox(tmp_path / "c")
    writer = X.BatchWriter(box, 10)
    rows = spark.range(25).collect()
    writer.write(iter(rows[:12]))
    writer.commit([writer.write(iter(rows)), None])
    assert sorted(r["id"] for b in box.sent() for r in b) == list(range(25))
    writer.abort([writer.write(iter(rows))])
    assert len(box.sent()) == 3


def test_index_of_other_tenants_is_not_touched(spark, tmp_path):
    path = str(tmp_path / "index")
    entries = lambda rows: spark.createDataFrame(rows, "tenant_id string, name string, node_ids array<long>")
    nodes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3)], "tenant_id string, node_id long")
    write_index(entries([("a", "x", [1, 2, 9]), ("a", "y", [9]), ("b", "z", [1]), ("c", "w", [3])]), nodes, path)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/tenant_id=b/*.parquet")}
    before = files()
    # a gets another index, c loses its last entry
    write_index(entries([("a", "v", [2, 1]), ("c", "w", [4])]), nodes, path)
    got = sorted((r.tenant_id, r.name, tuple(r.node_ids)) for r in read_index(spark, path).collect())
    assert got == [("a", "v", (2, 1)), ("b", "z", (1,))]
    assert files() == before


def test_outline_of_a_long_document(spark):
    """Twenty thousand headings: the open ones are carried along, not looked up for each chunk."""
    text = "\n".join(f"{'#' * (1 + i * 7 % 5)} h{i}\n" + "word " * 40 for i in range(20_000))
    rows = chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text").select("heading_path", "end_line").collect()
    path, want, line = [], {}, 0
    for i in range(20_000):
        depth = 1 + i * 7 % 5
        path = [*path[: depth - 1], *[None] * (depth - 1 - len(path)), f"h{i}"]
        want[line] = want[line + 1] = list(path)
        line += 2
    assert len(rows) > 1000 and all(r.heading_path == want[r.end_line] for r in rows)


def test_files_of_records_are_few(spark):
    from leadspan.catalog import files
    from leadspan.catalog.views import Views
    from leadspan.sources.files import read_visitors

    people = spark.range(3000).select(F.col("id").alias("no"), F.concat(F.lit("p"), "id").alias("providerId"))
    folder = files._record_files(Views(spark, "/root/testdata/sf0.001"), "visitors", people)
    assert spark.read.text(folder, wholetext=True).count() == 1
    assert sorted(r.provider_id for r in read_visitors(spark, folder).select("provider_id").collect()) == sorted(f"p{i}" for i in range(3000))


def test_openings_without_closing_tag_take_no_long_time(spark):
    import time

    from leadspan.sources.html import ENTITIES, HTML_STEPS, MARK, html_to_markdown

    def plain(c):
        for pattern, replacement in HTML_STEPS:
            c = F.regexp_replace(c, pattern, replacement)
        for entity, char in ENTITIES:
            c = F.replace(c, F.lit(entity), F.lit(char))
        return F.btrim(F.regexp_replace(c, r"\n{3,}", "\n\n"))

    random.seed(4)
    parts = ["<b>", "</b>", "<B x>", "<body>", "<strong>", "</STRONG>", "<i>", "</i>", "<img a>", "<em>", "</em>", "<b", "</b", "x", " y ", "é", ">", "<", MARK, "<" + MARK + "b>"]
    rows = [("".join(random.choices(parts[: len(parts) - (i % 2) * 2], k=random.randint(0, 14))),) for i in range(400)] + [(None,)]
    got = spark.createDataFrame(rows, "h string").select(html_to_markdown(F.col("h")).alias("a"), plain(F.col("h")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    text = "<body>" + "<button>word</button><img x>some more words\n" * 12000
    df = spark.createDataFrame([(text,)], "h string")
    start = time.time()
    assert df.select(html_to_markdown(F.col("h")).alias("t")).first().t.startswith("word")
    assert time.time() - start < 10
