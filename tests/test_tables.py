"""Crawl, audit, snapshot, run and streaming operators on small tables, against brute force where there is one."""

import hashlib
import json
import os
import time
from collections import defaultdict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sitelake import fixed_values as fv
from sitelake.config import SiteConfig, complete_config, with_config, with_config_by_key
from sitelake.functions.hashing import as_bytes, blob_sha
from sitelake.operators import audit as au
from sitelake.operators import crawl as cr
from sitelake.operators import files as fi
from sitelake.operators import fingerprint as fp
from sitelake.operators import languages as la
from sitelake.operators import runs as ru
from sitelake.operators import snapshot as sn
from sitelake.operators.extract import audit_refs, discovered_links, with_site
from sitelake.sources import tables as tb
from sitelake.streaming import pages as sp

PAGES = "page_id long, url string, html string"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def page_table(spark, *pages):
    return with_site(spark.createDataFrame([(i, url, html) for i, (url, html) in enumerate(pages)], PAGES))


# --- hashing --------------------------------------------------------------------------------------


def git_blob(body: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()


def git_tree(files: dict[str, str]) -> dict[str, str]:
    """Folder hashes of {path: blob sha}, the plain recursive way."""
    out = {}

    def walk(prefix: str) -> str:
        names = {p[len(prefix):].split("/")[0]: "/" in p[len(prefix):] for p in files if p.startswith(prefix)}
        entries = []
        for name, is_dir in names.items():
            sha = walk(f"{prefix}{name}/") if is_dir else files[prefix + name]
            mode = "40000" if is_dir else "100644"
            entries.append((name + "/" * is_dir, f"{mode} {name}".encode() + b"\0" + bytes.fromhex(sha)))
        raw = b"".join(e for _, e in sorted(entries, key=lambda e: e[0].encode()))
        out[prefix.rstrip("/")] = hashlib.sha1(b"tree %d\0" % len(raw) + raw).hexdigest()
        return out[prefix.rstrip("/")]

    walk("")
    return out


def test_blob_sha(value):
    for text in ("", "hello\n", "é%"):
        assert value(lambda t: blob_sha(as_bytes(t)), text) == git_blob(text.encode())


TREE = {f"d/{'x' * (i % 7)}{i}.html": git_blob(b"%d" % i) for i in range(300)} | {
    "d.txt": git_blob(b"a"), "d-e/f/g": git_blob(b"b"), "é/1": git_blob(b"c"), "z": git_blob(b"d")
}


def tree_table(spark, files, sites=("a", "b")):
    data = [(site, p, s, None) for site in sites for p, s in files.items()]
    return spark.createDataFrame(data, "site string, path string, sha string, mode string")


def hashes_of(files, sites=("a", "b")):
    return sorted((site, d, s) for site in sites for d, s in git_tree(files).items())


@pytest.mark.parametrize(("ranges", "piece"), [(None, 8_192), (1, 8_192), (2, 7), (40, 50)])
def test_folder_hashes_for_any_ranges_and_pieces(spark, monkeypatch, ranges, piece):
    monkeypatch.setattr(fp, "PIECE", piece)
    found = rows(fp.tree_fingerprint(tree_table(spark, TREE).repartition(7), ranges), "site", "dir", "sha")
    assert found == hashes_of(TREE)


def test_folder_hashes_of_no_files(spark):
    assert fp.tree_fingerprint(tree_table(spark, {})).collect() == []


def test_folds_pass_batches_of_any_size(spark):
    """A folder's head, entries and borders may fall anywhere in the batches of a task."""
    import pyarrow as pa

    entries = [b"entry %d" % i * (i % 5 + 1) for i in range(40)]
    head = b"tree %d\0" % sum(map(len, entries))
    whole = [("s", "d", None if i else sum(map(len, entries)) + len(head), e) for i, e in enumerate([head, *entries])]
    other = [("s", "e", None, b"left over")], [("s", "f", 99, b"cut")]
    for size in (1, 3, 100):
        data = [*other[0], *whole, *other[1]]
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*data[k : k + size]), (pa.string(), pa.string(), pa.int64(), pa.binary()))], ["site", "dir", "due", "entry"])
            for k in range(0, len(data), size)
        ]
        out = [tuple(r.values()) for b in fp._fold(iter(batches)) for r in b.to_pylist()]
        assert out == [("s", "e", None), ("s", "d", hashlib.sha1(head + b"".join(entries)).hexdigest()), ("s", "f", None)]


@pytest.mark.parametrize("seed", range(3))
def test_updated_fingerprint_equals_a_full_run(spark, seed):
    import random

    rng = random.Random(seed)
    name = lambda: "/".join(rng.choice("abc") + rng.choice(["", ".x", "-"]) for _ in range(rng.randrange(1, 5)))
    files = {}
    while len(files) < 60:
        path = name() + f"/f{len(files)}"
        files[path] = git_blob(path.encode())
    after = dict(files)
    for path in rng.sample(sorted(files), 8):
        if rng.random() < 0.5:
            del after[path]
        else:
            after[path] = git_blob(b"new")
    after |= {"brand/new/folder/file": git_blob(b"1"), "top": git_blob(b"2")}
    before_table, after_table = tree_table(spark, files), tree_table(spark, after, ("a",)).unionByName(tree_table(spark, files, ("b",)))
    nodes = fp.tree_fingerprint(before_table)
    found = rows(fp.updated_fingerprint(nodes, before_table, after_table, 3), "site", "dir", "sha")
    assert found == sorted(hashes_of(after, ("a",)) + hashes_of(files, ("b",)))
    assert rows(fp.updated_fingerprint(nodes, before_table, before_table), "site", "dir", "sha") == hashes_of(files)


def test_an_update_hashes_only_folders_above_changes(spark, monkeypatch):
    before = tree_table(spark, TREE)
    after = tree_table(spark, TREE | {"é/1": git_blob(b"x")}, ("a",)).unionByName(tree_table(spark, TREE, ("b",)))
    nodes, hashed, level = fp.tree_fingerprint(before), [], fp._level
    monkeypatch.setattr(fp, "_level", lambda entries, ranges: hashed.append(level(entries, ranges)) or hashed[-1])
    fp.updated_fingerprint(nodes, before, after)
    assert sorted(r for done in hashed for r in rows(done, "site", "dir")) == [("a", ""), ("a", "é")]


# --- crawl ----------------------------------------------------------------------------------------


def test_capture_split(spark):
    table = spark.createDataFrame(
        [("s", "a", 200, None, "x"), ("s", "b", 404, None, "x"), ("s", "c", 200, "timeout", "x"), ("s", "d", 200, None, "")],
        "site string, url string, status int, error string, body string",
    )
    ok, failed = cr.capture_split(table)
    assert rows(ok, "url") == [("a",)]
    assert rows(failed, "url", "reason") == [("b", "HTTP 404"), ("c", "timeout")]


def test_reach_is_breadth_first_with_cycles(spark):
    links = {1: [2, 3], 2: [4], 3: [4, 1], 4: [5], 6: [7], 5: [99]}
    edges = spark.createDataFrame([("s", str(a), str(b)) for a, bs in links.items() for b in bs], "site string, src string, dst string")
    captured = spark.createDataFrame([("s", str(i)) for i in range(1, 8)], "site string, url string")
    seeds = spark.createDataFrame([("s", "1"), ("s", "77")], "site string, url string")
    assert rows(cr.crawl_reach(edges, seeds, captured), "url", "depth") == [("1", 0), ("2", 1), ("3", 1), ("4", 2), ("5", 3)]


def test_a_round_of_the_walk_moves_only_what_it_found(spark):
    from sitelake.session import BucketedTable, bucketed

    rng = range(400)
    edges = spark.createDataFrame([("s", str(i), str((i * 7 + 1) % 400)) for i in rng], "site string, src string, dst string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    links, visited = bucketed(edges, "t", "site", "src"), BucketedTable(spark, "t", "site", "url", part="depth")
    try:
        start = edges.filter("src % 40 = 0").select("site", F.col("src").alias("url"))
        rows_ = visited.append(start.withColumn("depth", F.lit(0)))
        for depth in (1, 2):
            new = cr.unvisited(rows_.filter(F.col("depth") == depth - 1), links.rows(), rows_)
            plan = new._jdf.queryExecution().executedPlan().toString()
            # One exchange, that of the URLs found; the tables are read as they lie, and only the last depth is the frontier.
            assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 3
            assert "(depth#" in plan and "PartitionFilters" in plan
            rows_ = visited.append(new.withColumn("depth", F.lit(depth)))
        assert rows_.filter("depth = 1").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        links.drop()
        visited.drop()


def test_a_failed_walk_leaves_nothing_in_the_catalog(spark, monkeypatch):
    edges = spark.createDataFrame([("s", "1", "2")], "site string, src string, dst string")
    captured = spark.createDataFrame([("s", "1"), ("s", "2")], "site string, url string")
    tables = {t.name for t in spark.catalog.listTables()}

    def broken(*_):
        raise RuntimeError("a round failed")

    monkeypatch.setattr(cr, "unvisited", broken)
    with pytest.raises(RuntimeError, match="a round failed"):
        cr.crawl_reach(edges, captured, captured)
    assert {t.name for t in spark.catalog.listTables()} == tables


@pytest.mark.parametrize("bits", [1 << 15, 1 << 18])
def test_seen_urls_are_filtered_before_the_join(spark, bits):
    seen = spark.range(50_000).select(F.concat(F.lit("s"), F.col("id") % 7).alias("site"), F.md5(F.col("id").cast("string")).alias("url_key"))
    found = spark.range(49_000, 51_000, 4).select(F.concat(F.lit("s"), F.col("id") % 7).alias("site"), F.md5(F.col("id").cast("string")).alias("url_key"), F.col("id").cast("string").alias("url"))
    found = found.unionAll(found)
    assert rows(cr.new_urls_of_many(found, seen, bits)) == rows(cr.new_urls(found, seen))
    kept = cr.possibly_found(found, seen, bits)
    assert kept.join(found, ["site", "url_key"], "left_semi").count() == 250 and kept.count() < 50_000 * 2 * 500 / bits + 350
    assert cr.new_urls_of_many(found.limit(0), seen).count() == 0 and cr.new_urls_of_many(found, seen.limit(0)).count() == 500


def test_home_page_alone_decides_languages(spark):
    link = '<a href="/{0}/x">x</a>'
    pages = [("a.com", "index.html", 1, link.format("de") * 2 + link.format("fr")), ("a.com", "p.html", 2, link.format("fr") * 5 + link.format("it") * 2), ("b.com", "p.html", 3, link.format("de") * 2),
             ("c.com", "index.html", 4, link.format("es")), ("c.com", "index.html", 5, link.format("es"))]
    assert rows(la.home_languages(spark.createDataFrame(pages, "site string, page_path string, page_id long, html string"))) == [("a.com", "de")]


def test_discovery_by_kind(spark):
    captures = spark.createDataFrame(
        [
            ("h.com", "https://h.com", "https://h.com/a.css", "a.css", "text/css", "@import 'x.css';p{b:url(data:x) url(y.png)}"),
            ("h.com", "https://h.com", "https://h.com/m/s.xml", "m/s.xml", "text/xml",
             "<?xml-stylesheet href='t.xsl'?><urlset><loc> https://h.com/p?a&amp;b </loc><image:loc>rel.png</image:loc>"),
            ("h.com", "https://h.com", "https://h.com/robots.txt", "robots.txt", "text/plain", "x\n Sitemap: https://h.com/z.xml "),
            ("h.com", "https://h.com", "https://h.com/data", "data", "application/json", 'href="/no"'),
        ],
        "site string, base string, url string, page_path string, content_type string, body string",
    )
    found = rows(discovered_links(captures), "source", "url")
    assert found == [
        ("css_import", "https://h.com/x.css"),
        ("css_url", "https://h.com/y.png"),
        ("robots_sitemap", "https://h.com/z.xml"),
        ("sitemap_loc", "https://h.com/p?a&b"),
        ("sitemap_media", "rel.png"),
        ("sitemap_stylesheet", "https://h.com/m/t.xsl"),
    ]


def test_progress_counts_unseen_sites(spark):
    captures = spark.createDataFrame([("a", 200, None, "x"), ("a", 500, None, "x")], "site string, status int, error string, body string")
    seen = spark.createDataFrame([("b", "k")], "site string, url_key string")
    assert rows(cr.crawl_progress(captures, seen)) == [("a", 2, 1, 1), ("b", 0, 1, 0)]


def test_languages_need_two_links_or_a_tag(spark):
    pages = page_table(
        spark,
        ("https://h.com/", '<link rel=alternate hreflang="x" href="https://h.com/fr/"><a href="/de/a"><a href="/de/b"><a href="/it/">'),
        ("https://h.com/b", '<a href="https://o.com/es/"><a href="https://o.com/es/"><a href="/EN-us/x"><a href="/en-US">'),
    )
    assert rows(la.site_languages(pages)) == [("h.com", "de"), ("h.com", "en-us"), ("h.com", "fr")]


# --- audit ----------------------------------------------------------------------------------------

GOOD = '<html lang="en"><head><title>t</title><meta name=DESCRIPTION content=d><link rel="x canonical" href=c></head><h1>h</h1><img alt>'


def test_a_good_page_has_no_findings(spark):
    pages = page_table(spark, ("https://h.com/", GOOD))
    assert au.page_findings(pages, SiteConfig(site_domain="h.com")).count() == 0


def test_findings(spark):
    bad = '<!-- <title>x</title> --><script>"<h1>"</script><title> \n</title><h1>a<H1 class=x><img src=x><img data-alt=y><html><meta name="description" content=" ">'
    pages = page_table(spark, ("https://h.com/", bad + "http:\\/\\/a.h.com http://h.com.evil.com http://h.com/ admin.x.com"))
    cfg = SiteConfig(site_domain="h.com")
    assert rows(au.page_findings(pages, cfg), "code", "n") == [
        ("ALT", 2), ("CANONICAL", 1), ("H1", 2), ("HTTPS", 2), ("LANG", 1), ("META", 1), ("STAGING", 1), ("TITLE", 1)
    ]
    mapped = SiteConfig(source_host="h.com", target_host="n.com", force_https=False)
    codes = dict(rows(au.page_findings(pages, mapped), "code", "n"))
    assert codes["DOMINIO"] == 1 and "STAGING" not in codes and "HTTPS" not in codes


def brute_broken(pages, files):
    out = set()
    for site, page, ref, target in pages:
        if target not in files[site] and target.rstrip("/") + "/index.html" not in files[site]:
            out.add((site, page, ref))
    return sorted(out)


def test_broken_links_against_brute_force(spark):
    refs = ["/a", "/a/", "/b.html", "/b.html/", "c", "../d/", "/", "/missing", "/e/index.html", "/x?y", "//o.com", "/a", "/index.html/"]
    html = "".join(f'<a href="{r}">' for r in refs) + '<img srcset="/i.png 1x, /j.png 2x"><script>href="/no"</script>'
    pages = page_table(spark, ("https://h.com/p/", html), ("https://g.com/", html))
    files = spark.createDataFrame(
        [("h.com", p) for p in ("a/index.html", "b.html", "p/c", "d/index.html", "i.png")] + [("g.com", "index.html")],
        "site string, path string",
    )
    known = defaultdict(set)
    for r in files.collect():
        known[r.site].add(r.path)
    targets = rows(au.page_targets(pages), "site", "page_path", "ref", "target")
    found = rows(au.broken_links(pages, files))
    assert found == brute_broken(targets, known)
    strict = rows(au.broken_links(pages, files, strict=True))
    assert ("g.com", "index.html", "/") in strict and ("g.com", "index.html", "/") not in found
    everything = spark.createDataFrame([(s, t.rstrip("/")) for s, _, _, t in targets], "site string, path string")
    both = everything.unionByName(everything.withColumn("path", F.concat("path", F.lit("/index.html"))))
    assert au.broken_links(pages, both).count() == 0


def test_a_hot_target_is_split(spark):
    """One link on every page: adaptive execution splits the partition of the hot target and nothing is lost."""
    n = 60_000
    hot = spark.range(n).select(
        F.lit("s").alias("site"), F.concat(F.lit("p"), "id").alias("page_path"), F.lit("/gone" + "x" * 200).alias("ref"),
        F.when(F.col("id") % 3 == 0, F.lit("gone" + "x" * 200)).otherwise(F.concat(F.lit("t"), "id")).alias("target"),
    )
    files = spark.range(n).select(F.lit("s").alias("site"), F.concat(F.lit("t"), "id").alias("path"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        lost = au.missing_targets(hot.repartition(8), files)
        assert len(lost.collect()) == n // 3
        assert "skew=true" in lost._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_no_nested_loop_in_the_link_check(spark):
    pages = page_table(spark, ("https://h.com/", "<a href=/x>"))
    files = spark.createDataFrame([("h.com", "y")], "site string, path string")
    plan = au.broken_links(pages, files)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_report_has_fallback_lines(spark):
    pages = page_table(spark, ("https://h.com/", GOOD + "<a href=/x>"))
    files = spark.createDataFrame([("h.com", "index.html")], "site string, path string")
    report = tb.report_lines(au.page_findings(pages, SiteConfig()), au.broken_links(pages, files))
    lines = [r.line for r in report.orderBy("site", "section", "rank", "line").collect()]
    assert lines[0] == "BROKEN LINKS (2)" and lines[-1] == "no SEO finding" and len(lines) == 5


# --- snapshots ------------------------------------------------------------------------------------

SNAP = "site string, path string, sha string, mode string"


def test_reuse_is_by_content_and_difference_by_path(spark):
    local = spark.createDataFrame([("s", "new", "1"), ("s", "same", "2"), ("s", "moved", "3"), ("s", "copy", "9"), ("s", "copy2", "9")], "site string, path string, sha string")
    old = spark.createDataFrame(
        [("s", "same", "2", "100644"), ("s", "old", "3", "100644"), ("s", "ReadMe.md", "5", "100755"), ("s", "d/README.md", "6", "100644"), ("t", "x", "1", "100644")], SNAP
    )
    delta = sn.publish_delta(local, old)
    assert rows(delta, "path", "action") == [("copy", "needed"), ("copy2", "needed"), ("moved", "reused"), ("new", "needed"), ("same", "reused")]
    assert rows(sn.unique_blobs(delta), "sha", "path") == [("1", "new"), ("9", "copy")]
    summary = sn.delta_summary(delta).first()
    assert summary.files == summary.reused + summary.needed == 5
    kept = sn.preserved_files(local, old, SiteConfig())
    assert rows(kept, "path") == [("ReadMe.md",)]
    diff = dict(rows(sn.snapshot_diff(local, old, SiteConfig()).filter("site = 's'"), "path", "action"))
    assert diff == {"new": "added", "copy": "added", "copy2": "added", "moved": "added", "same": "unchanged", "old": "removed", "ReadMe.md": "preserved", "d/README.md": "removed"}
    assert ("s", "old") in rows(sn.removed_paths(local, old, kept))
    assert rows(sn.merged_tree(local, kept), "path", "mode")[0] == ("ReadMe.md", "100755")
    own = sn.snapshot_diff(local, local, SiteConfig())
    assert own.filter("action <> 'unchanged'").count() == 0


def test_an_exported_file_wins_over_a_preserved_one(spark):
    local = spark.createDataFrame([("s", "CNAME", "1")], "site string, path string, sha string")
    old = spark.createDataFrame([("s", "CNAME", "2", "100644")], SNAP)
    assert sn.preserved_files(local, old, SiteConfig()).count() == 0


def test_tree_documents(spark, tmp_path):
    document = {"site": "s", "sha": "t", "tree": [
        {"path": "a", "type": "blob", "sha": "1"}, {"path": "d", "type": "tree", "sha": "2"}, {"path": "b", "type": "blob"}, {"path": "c", "type": "blob", "sha": "3", "mode": "100755"}]}
    (tmp_path / "t.json").write_text(json.dumps(document))
    documents = tb.read_tree_documents(spark, str(tmp_path))
    assert rows(tb.tree_entries(documents)) == [("s", "a", "1", "100644"), ("s", "c", "3", "100755")]
    assert rows(tb.tree_meta(documents)) == [("s", "t", False)]


def test_file_tree_source_and_sinks(spark, tmp_path):
    (tmp_path / "x" / "d").mkdir(parents=True)
    (tmp_path / "x" / "a.txt").write_text("é")
    (tmp_path / "x" / "d" / "b.html").write_text("h")
    files = tb.read_file_tree(spark, str(tmp_path / "x"), "s")
    assert rows(files, "path", "size") == [("a.txt", 2), ("d/b.html", 1)]
    assert rows(sn.snapshot(files), "path", "sha") == [("a.txt", git_blob("é".encode())), ("d/b.html", git_blob(b"h"))]
    folder = str(tmp_path / "snap")
    shape = "site string, path string, body binary, size long"
    tb.write_snapshot(files.filter("size = 1").withColumn("path", F.lit("left by a failed attempt")), folder, "r1", 4)
    tb.write_snapshot(files, folder, "r2", 4)
    for _ in range(2):
        tb.write_snapshot(files, folder, "r1", 4)
        for run in ("r1", "r2"):
            assert rows(tb.read_snapshot(spark, folder, run, shape), "path", "size") == [("a.txt", 2), ("d/b.html", 1)]
    changed = spark.createDataFrame([("s", "a", "1", "1"), ("s", "b", "1", "2"), ("s", "c", None, "1")], "site string, path string, body string, new_body string")
    tb.write_changed(changed, str(tmp_path / "changed"), "r1", 4)
    assert rows(tb.read_snapshot(spark, str(tmp_path / "changed"), "r1", "site string, path string, body string"), "path", "body") == [("b", "2"), ("c", "1")]


def test_file_tree_round_trip(spark, tmp_path):
    table = [("a.com", "index.html", "<p>é</p>"), ("a.com", "x y/%41+b.html", "2"), ("b.com", "é/1", ""), ("b.com", "../out", "no"), ("b.com", "x/..", "no"), ("b.com", "n", None)]
    files = spark.createDataFrame(table, "site string, path string, body string")
    folder = str(tmp_path / "tree")
    for _ in range(2):
        assert rows(tb.write_file_tree(files, folder)) == [("a.com", "index.html", 9), ("a.com", "x y/%41+b.html", 1), ("b.com", "é/1", 0)]
    found = rows(tb.read_file_tree(spark, folder).select("site", "path", F.decode("body", "UTF-8")))
    # Spark's file readers pass over empty files.
    assert found == [("a.com", "index.html", "<p>é</p>"), ("a.com", "x y/%41+b.html", "2")] and (tmp_path / "tree" / "b.com" / "é" / "1").exists()
    assert not (tmp_path / "out").exists()


def test_file_tree_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    names = [f"s{i % 3}/d{i % 7}/{i}.html" for i in range(400)] + ["s0/x y/%41+#b.html", "s0/é/_a=b/c", "s0/e.d/.f", "s0/_h/i", "s0/.j/k", "s0/l._COPYING_", "s1/_metadata/m", "s1/_metadata.n", "o", "s2/empty"]
    for name in names:
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text("" if name == "s2/empty" else f"<{name}>")
    (tmp_path / "tree" / "s2" / "link").symlink_to(tmp_path / "tree" / "s0" / "x y")
    (tmp_path / "tree" / "s2" / "gone").symlink_to(tmp_path / "tree" / "nowhere")
    folder = str(tmp_path / "tree")
    monkeypatch.setattr(tb, "_LISTED", 0)
    monkeypatch.setattr(tb, "_ROWS", 3)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        expected = rows(tb._listed_by_spark(spark, folder), "path", "body", "size")
        assert len(expected) == 405 and {name for name, _, _ in expected} >= {"s0/é/_a=b/c", "s1/_metadata/m", "s2/link/%41+#b.html", "o"}
        with monkeypatch.context() as only:
            only.setattr(tb, "_listed_by_spark", None)
            for top in (folder, f"file://{folder}/", os.path.relpath(folder)):
                found = tb.read_file_tree(spark, top, "s")
                assert rows(found, "path", "body", "size") == expected
            # Tasks do not grow with the files, as splits of Spark's reader do.
            assert found.rdd.getNumPartitions() == 4
            assert rows(tb.read_file_tree(spark, folder).filter("site = 'o'"), "site", "path") == [("o", None)]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tb.read_file_tree(spark, f"{folder}/nowhere")


def test_file_tree_source_hashes_before_the_join(spark, tmp_path):
    from __spark_entry__ import queries

    pages = [(i, f"https://s{i % 2}.com/{i}", f"<p>é{i}") for i in range(30)]
    spark.createDataFrame(pages, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(7, "B#1", "SMALL")], "p_partkey long, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    found = queries()["file_tree_source"](spark, str(tmp_path))
    expected = [(f"s{i % 2}.com", f"p/{i % 10}/{i}/index.html", html) for i, _, html in pages] + [("shop.example.com", "img/B#1/7.png", "SMALL")]
    assert rows(found) == sorted((site, path, git_blob(body.encode()), len(body.encode())) for site, path, body in expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The join moves hashes and no bodies.
    assert 0 <= plan.index("Join") < plan.index("sha1(")


def test_sitemaps_are_followed_through_indexes(spark, tmp_path):
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>\n {n} </loc><lastmod>x</lastmod></sitemap>" for n in names) + "</sitemapindex>"
    pages = lambda *urls: "<urlset xmlns:image='i'>" + "".join(f"<url><loc>{u}</loc><image:image><image:loc>no</image:loc></image:image></url>" for u in urls) + "</urlset>"
    many = [f"m{i}" for i in range(20_000)]
    for name, text in {
        "root.xml": index("a.xml", "deep.xml", "missing.xml"), "deep.xml": index("b.xml", "root.xml"), "a.xml": pages("1", "2?x=1&amp;y=2"), "b.xml": pages("3", "1"),
        "lost.xml": pages("4"), "big.xml": pages(*many), "second.xml": index("big.xml"),
    }.items():
        (tmp_path / name).write_text(text)
    top = f"file://{tmp_path}/"
    roots = spark.createDataFrame([(f"{top}{n}",) for n in ("root.xml", "second.xml", "nowhere.xml")], "file string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = tb.read_sitemaps(spark, str(tmp_path), lambda url: F.concat(F.lit(top), url), roots)
        assert rows(found.filter("loc not like 'm%'").select(F.substring_index("file", "/", -1), "loc", "depth")) == [("a.xml", "1", 1), ("a.xml", "2?x=1&y=2", 1), ("b.xml", "1", 2), ("b.xml", "3", 2)]
        # A file larger than a split is read by several tasks, each entry once.
        big = tb._sitemap_rows(spark, f"{tmp_path}/big.xml", "url")
        assert big.rdd.getNumPartitions() > 5 and sorted(r["loc"] for r in big.collect()) == sorted(many)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sitemaps_are_read_by_name_and_not_listed(spark, tmp_path, monkeypatch):
    top = f"file://{tmp_path}/maps/"
    (tmp_path / "maps" / "x y").mkdir(parents=True)
    (tmp_path / "maps" / "root.xml").write_text(f"<sitemapindex><sitemap><loc>x%20y/a.xml</loc></sitemap><sitemap><loc>../out.xml</loc></sitemap><sitemap><loc>_b.xml</loc></sitemap>{' ' * 3_000_000}</sitemapindex>")
    for name in ("maps/x y/a.xml", "out.xml", "maps/_b.xml"):
        (tmp_path / name).write_text(f"<urlset><url><loc>{name[-5]}&amp;é</loc></url>{' ' * 2_000_000}<url><loc>2</loc></url></urlset>")
    roots = spark.createDataFrame([(f"{top}root.xml",), (None,)], "file string")
    listed = tb._listed_sitemaps(spark, str(tmp_path / "maps"), lambda url: F.concat(F.lit(top), url), roots)
    expected = [(f"{top}x%20y/a.xml", "2", 1), (f"{top}x%20y/a.xml", "a&é", 1)]
    assert rows(listed, "file", "loc", "depth") == expected
    monkeypatch.setattr(tb, "_sitemap_rows", None)
    for folder in (f"{tmp_path}/maps", f"file://{tmp_path}/maps"):
        assert rows(tb.read_sitemaps(spark, folder, lambda url: F.concat(F.lit(top), url), roots), "file", "loc", "depth") == expected


def test_sites_of_equal_roots_are_not_read(spark, tmp_path):
    local = [(f"s{i}", "a", f"{i}") for i in range(60)] + [("s7", "b", "x")]
    old = [(f"s{i}", "a", f"{i}") for i in range(60)] + [("s7", "c", "y"), ("gone", "z", "1")]
    for run, data in (("new", local), ("old", old)):
        tb.write_snapshot(spark.createDataFrame(data, "site string, path string, sha string"), str(tmp_path / "snap"), run, 16)
    roots = [(f"s{i}", "r", "r") for i in range(60) if i != 7] + [("s7", "r", "q"), ("gone", None, "r")]
    paired = spark.createDataFrame(roots, "site string, root_sha string, old_root_sha string").withColumn("shard", tb.site_shard(F.col("site"), 16))
    paired.write.parquet(str(tmp_path / "roots"))
    stored = [tb.read_snapshot(spark, str(tmp_path / "snap"), run, "site string, path string, sha string") for run in ("new", "old")]
    found = sn.site_changes(*stored, spark.read.parquet(str(tmp_path / "roots")), SiteConfig())
    assert rows(found, "site", "path", "action") == [("gone", "z", "removed"), ("s7", "b", "added"), ("s7", "c", "removed")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("dynamicpruningexpression") >= 2
    assert rows(sn.changed_sites(sn.paired_roots(paired.select("site", "root_sha"), paired.select("site", F.col("old_root_sha").alias("root_sha")))), "site") == [("gone",), ("s7",)]


def test_report_findings_and_failures_are_written(spark, tmp_path):
    findings = spark.createDataFrame([("s", "p", "H1", 2, "d")], "site string, page_path string, code string, n long, detail string")
    broken = spark.createDataFrame([("s", "p", "/x")], "site string, page_path string, ref string")
    tb.write_findings(findings, broken, str(tmp_path / "f"))
    assert rows(spark.read.parquet(str(tmp_path / "f" / "findings"))) == rows(findings) and rows(spark.read.parquet(str(tmp_path / "f" / "broken_links"))) == rows(broken)
    tb.write_report(tb.report_lines(findings, broken), str(tmp_path / "r"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert text == ["BROKEN LINKS (1)", "p -> /x", "SEO AUDIT (1)", "[H1] p: d"]
    tb.write_failed(broken, str(tmp_path / "x"))
    assert rows(spark.read.parquet(str(tmp_path / "x"))) == rows(broken)


# --- files ----------------------------------------------------------------------------------------


def test_not_found_page_and_pruning(spark):
    files = spark.createDataFrame(
        [("s", p, p) for p in ("404_not_found/index.html", "404_not_found/x", "404.html", "a/feed/x.html", "feed.html", "j.js", "js/fuse.js")] + [("t", "404.html", "own")],
        "site string, path string, body string",
    )
    assert rows(fi.promote_not_found(files).filter("path = '404.html'"), "site", "body") == [("s", "404_not_found/index.html"), ("t", "own")]
    assert "404_not_found/x" not in {r.path for r in fi.promote_not_found(files).collect()}
    pruned = {r.path for r in fi.prune_tree(files, SiteConfig()).collect()}
    assert pruned.isdisjoint({"a/feed/x.html", "j.js"}) and {"feed.html", "js/fuse.js"} <= pruned
    assert "j.js" in {r.path for r in fi.prune_tree(files, SiteConfig(keep_js=True)).collect()}


def test_clashes(spark):
    captures = spark.createDataFrame([("s", "u1", "a"), ("s", "u2", "a"), ("s", "u3", "a/b"), ("s", "u4", "c")], "site string, url string, path string")
    assert rows(fi.path_clash(captures), "path", "kind", "n_urls") == [("a", "file and folder", 1), ("a", "same path", 2)]
    images = spark.createDataFrame([("s", "a.png"), ("s", "a.JPG"), ("s", "b.jpeg"), ("s", "c.gif")], "site string, path string")
    assert rows(fi.image_rename_plan(images), "path", "webp", "clash") == [("a.JPG", "a.webp", True), ("a.png", "a.webp", True), ("b.jpeg", "b.webp", False)]


def test_config_join_fills_defaults(spark):
    config = complete_config(spark.createDataFrame([("s", "x.com", None)], "site string, target_host string, keep_js boolean"))
    table = spark.createDataFrame([("s", 1), ("t", 2)], "site string, n int")
    found = rows(with_config(table, config), "n", "target_host", "keep_js", "production_label", "keep_exports")
    assert found == [(1, "x.com", False, "www", 2), (2, "", False, "www", 2)]


def test_config_join_of_dealt_out_sites_equals_the_plain_one(spark):
    config = spark.createDataFrame([("big", "x.com"), ("c3", "y.com"), ("none", "z.com")], "site string, target_host string")
    table = spark.createDataFrame(
        [("big", str(i)) for i in range(300)] + [(f"c{i % 40}", str(i)) for i in range(100)] + [(None, "n"), (None, None), ("big", None)], "site string, path string"
    )
    plain = rows(with_config(table, config).na.fill("-"))
    assert rows(with_config(table, config, "path").na.fill("-")) == plain
    assert rows(with_config_by_key(table, config, "path").na.fill("-")) == plain
    assert with_config(table.limit(0), config, "path").collect() == []


@pytest.mark.parametrize("share", [2, 3])
def test_no_task_of_the_config_join_holds_a_heavy_site(spark, share):
    """One site with half or a third of all rows, broadcasts and adaptive splits off: tasks stay even."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        table = spark.range(60_000).select(F.when(F.col("id") % share == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 4001)).alias("site"), F.col("id").cast("string").alias("path"))
        config = table.select("site", F.lit("x.com").alias("target_host")).distinct()
        joined = with_config(table, config, "path")
        sizes = sorted(n for _, n in rows(joined.groupBy(F.spark_partition_id()).count()))
        assert sum(sizes) == 60_000 and len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
        plain = sorted(n for _, n in rows(with_config(table, config).groupBy(F.spark_partition_id()).count()))
        assert plain[-1] > 4 * plain[8]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- runs -----------------------------------------------------------------------------------------


def test_retention_and_tails(spark):
    runs = spark.createDataFrame([(f"2024010{i}-000000", s) for s in "ab" for i in range(1, 6)] + [("20240101-000000", "c")], "run_id string, site string")
    kept = {(r.site, r.run_id) for r in ru.retain_newest(runs, 2).collect() if r.keep}
    assert kept == {("a", "20240105-000000"), ("a", "20240104-000000"), ("b", "20240105-000000"), ("b", "20240104-000000"), ("c", "20240101-000000")}
    assert ru.retain_newest(runs, 2).count() == 11
    config = spark.createDataFrame([("a", 4), ("b", 0)], "site string, keep_exports int")
    chosen = [(r.site, r.run_id[7]) for r in ru.retain_configured(runs, config).collect() if r.keep]
    assert sorted(chosen) == [("a", "2"), ("a", "3"), ("a", "4"), ("a", "5"), ("b", "5"), ("c", "1")]
    plan = ru.log_tail(spark.range(100).select((F.col("id") % 2).alias("run_id"), F.col("id").alias("line")), 3)
    assert rows(plan.select("run_id", "line")) == [(0, 94), (0, 96), (0, 98), (1, 95), (1, 97), (1, 99)]
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


# --- streams --------------------------------------------------------------------------------------


def split_pages(spark, folder, parts=3):
    """The small pages table as several files, some URLs in more than one."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    again = pages.withColumn("page_id", F.col("page_id") + 1000)
    both = pages.unionByName(again)
    for i in range(parts):
        both.filter(F.col("page_id") % parts == i).coalesce(1).write.mode("append").parquet(folder)
    return both


def test_ingest_equals_batch_and_survives_a_restart(spark, tmp_path):
    folder, seen, state = str(tmp_path / "in"), str(tmp_path / "seen"), str(tmp_path / "state")
    both = split_pages(spark, folder)
    first = sp.run_once(sp.ingest_new(sp.stream_pages(spark, folder, files_per_batch=1), seen, state))
    sizes = sp.state_sizes(first)
    assert len([s for s in sizes if s["added"]]) > 1 and sizes[-1]["bytes"] > 0 and all(s["late"] == 0 for s in sizes)
    # After a restart nothing that was seen comes again, whether its files or only its URLs come again.
    for _ in range(2):
        split_pages(spark, folder)
        again = sp.run_once(sp.ingest_new(sp.stream_pages(spark, folder, files_per_batch=1), seen, state))
        assert sum(s["added"] for s in sp.state_sizes(again)) == 0 and sp.state_sizes(again)[-1]["keys"] == sizes[-1]["keys"]
    stored = spark.read.parquet(seen)
    keyed = with_site(both).select("site", F.md5(F.concat("base", F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1))).alias("url_key"))
    assert rows(stored, "site", "url_key") == rows(keyed.distinct())
    assert sizes[-1]["keys"] == stored.count()


def test_a_batch_keeps_the_least_id_of_a_url(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://a.com/{i % 3}?{i}", "x") for i in range(50, 0, -1)], "page_id long, url string, html string")
    pages.repartition(5).write.parquet(str(tmp_path / "in"))
    sp.run_once(sp.ingest_new(sp.stream_pages(spark, str(tmp_path / "in")), str(tmp_path / "seen"), str(tmp_path / "state")))
    assert rows(spark.read.parquet(str(tmp_path / "seen")), "page_id", "url") == [(1, "https://a.com/1?1"), (2, "https://a.com/2?2"), (3, "https://a.com/0?3")]


def test_a_url_is_forgotten_after_its_life(spark, tmp_path):
    folder, seen, state = str(tmp_path / "in"), str(tmp_path / "seen"), str(tmp_path / "state")
    for k in range(3):
        spark.createDataFrame([(k, "https://a.com/", "x"), (10 + k, f"https://a.com/{k}", "x")], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(folder)
        sp.run_once(sp.ingest_new(sp.stream_pages(spark, folder), seen, state, life="1 second"))
        time.sleep(2)
    assert [r for r in rows(spark.read.parquet(seen), "page_id") if r[0] < 10] != [(0,)]


def test_audit_and_tally_streams_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    both = split_pages(spark, folder)
    cfg = SiteConfig(source_host=F.col("site"), target_host="n.com", site_domain=F.col("site"))
    sp.run_once(sp.audit_stream(sp.stream_pages(spark, folder, files_per_batch=1), cfg, str(tmp_path / "f"), str(tmp_path / "c1")))
    assert rows(spark.read.parquet(str(tmp_path / "f"))) == rows(au.page_findings(with_site(both), cfg))
    sp.run_once(sp.tally_stream(sp.stream_pages(spark, folder, files_per_batch=1), str(tmp_path / "t"), str(tmp_path / "c2")))
    assert rows(sp.tally_total(spark, str(tmp_path / "t"))) == rows(la.slug_tally(with_site(both)))


@pytest.mark.parametrize("single", [False, True])
def test_stream_queries_read_a_table_of_one_file_or_many(spark, tmp_path, single):
    from __spark_entry__ import queries

    pages = spark.createDataFrame([(i, f"https://a.com/{i % 30}?{i}", '<a href="/de/x">x</a>') for i in range(200)], PAGES)
    pages.repartition(1 if single else 5).write.parquet(str(tmp_path / ("one" if single else "pages.parquet")))
    for file in (tmp_path / "one").glob("*.parquet"):
        file.rename(tmp_path / "pages.parquet")
    found = queries()["stream_audit"](spark, str(tmp_path))
    assert found.filter("code = 'TITLE'").count() == 200
    assert rows(queries()["stream_links_total"](spark, str(tmp_path)), "site", "slug", "links") == [("a.com", "de", 200)]


def test_ingest_writes_arrivals_in_many_tasks(spark, tmp_path, monkeypatch):
    from sitelake.plans import q_stream

    pages = spark.createDataFrame([(i, f"https://a.com/{i % 30}?{i}", "x") for i in range(200)], PAGES)
    pages.repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    made = []
    monkeypatch.setattr(q_stream, "new_folder", lambda spark, name: made.append(str(tmp_path / name)) or made[-1])
    assert sorted(r[0] for r in rows(q_stream.stream_ingest(spark, str(tmp_path)), "page_id")) == list(range(30))
    assert len(list((tmp_path / "ingest" / "pages").glob("*.parquet"))) > 4


def test_short_rows_are_dealt_out_before_texts_are_made(spark, tmp_path):
    from sitelake.plans.inputs import load

    spark.createDataFrame([(i, "s", 1, 0.5) for i in range(400)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    pages = spark.createDataFrame([(1, "https://a.com/", "x")], PAGES)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    dealt = load(spark, str(tmp_path), "supplier").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 4 and max(r["count"] for r in dealt) <= 150
    # A filter on a text that is made of a row does not run where the file is scanned.
    long = load(spark, str(tmp_path), "stylesheets").filter(F.octet_length("body") > 15360)
    assert long.filter("path like 'css/1%'").count() == 100
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("repeat(", 0, plan.index("Repartition")) < plan.index("Repartition") and "repeat(" not in plan[plan.index("Repartition"):]


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    link = '<a href="/{0}/x">x</a>'
    def batch(*slugs):
        return spark.createDataFrame([(s, link.format(x)) for s, x in slugs], "site string, html string")
    out = str(tmp_path / "t")
    batches = [batch(("a.com", "de"), ("a.com", "de"), ("b.com", "fr")), batch(("a.com", "it"), ("c.com", "de")), batch(("a.com", "de"))]
    for number in (0, 0, 1, 1, 2, 1, 2, 2):  # the last ones again, as after a restart
        sp.store_tally(batches[number], number, out, 4)
    assert rows(sp.tally_total(spark, out)) == [("a.com", "de", 0, 3), ("a.com", "it", 0, 1), ("b.com", "fr", 0, 1), ("c.com", "de", 0, 1)]
    assert rows(sp.languages_so_far(spark, out)) == [("a.com", "de")]


# --- plans ----------------------------------------------------------------------------------------


def test_scans_read_only_what_is_needed(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = audit_refs(with_site(pages)).filter("page_id < 10").select("page_id", "ref")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(page_id), LessThan(page_id,10)]" in plan
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_the_shared_folder_comes_from_the_session(spark):
    from sitelake.session import new_folder, shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_fixed_values_are_complete():
    assert len(fv.DENY_PREFIXES) == 8 and len(fv.HOME_SEEDS) == 9


def test_few_rows_that_become_long_texts_meet_in_a_task(spark, tmp_path):
    """A writer of files looks at the bytes it holds every hundred rows or so, so that many texts of megabytes would fill a task's memory."""
    from sitelake.plans.inputs import load

    spark.range(400).selectExpr("id as s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    dealt = load(spark, str(tmp_path), "supplier").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in dealt) == 400 and max(r["count"] for r in dealt) <= 16
