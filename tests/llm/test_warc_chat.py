import hashlib
import random

import pytest

from stratalens.llm import bpe, chat, warc


def test_warc(spark):
    big, small = "x" * 100, "y" * 99
    rows = [(3, "http://a/\r\nX: 1", big), (1, None, big), (2, "u", big), (7, "u", None), (8, "u", ""), (5, "u", small), (4, "u", small), (None, "u", big), (9, "ü", "é" * 50), (10, "u", "é" * 50), (1, None, big), (11, "http://ü/é", "\r\n\r\n<p>" + big), (12, "u", "z" * 3_000_000 + "\r\n\r\n"), (13, "u", "z" * 3_000_000 + "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.op6(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        same = [i for i, _, h in rows if (h or "") == html and i is not None]
        again = len(html.encode()) >= 100 and r.page_id is not None and r.page_id > min(same)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", min(same)) if again else ("response", None))
    archive = warc.write(pages)
    assert archive.payloads.count() == len({h or "" for _, _, h in rows})
    for r in warc.read(archive).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert body[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n") and b"\r\nX: 1" not in head
        if r.record_type == "response":
            assert body[:length].partition(b"\r\n\r\n")[2] == bytes(r.payload)
    plan = warc.op6(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS record" in plan
    broken = warc.Archive(archive.headers, archive.payloads.selectExpr("digest", "cast(concat(string(payload), '!') as binary) payload"))
    with pytest.raises(Exception, match="does not match"):
        warc.read(broken).select("payload_digest").collect()
    assert warc.op6(pages.limit(0)).count() == 0


def test_archive_leaves_no_shuffle_of_payloads(spark, monkeypatch):
    """Once written, an archive's shuffle files are gone, with the collector at rest."""
    import os
    import time

    from stratalens import runtime

    def shuffled():
        local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for top in local for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    monkeypatch.setattr(runtime, "_swept", time.monotonic() + 1e6)
    rng = random.Random(4)
    pages = spark.createDataFrame([(i, "u", rng.randbytes(2000).hex()) for i in range(500)], "page_id long, url string, html string")
    before = shuffled()
    archive = warc.write(pages)
    until = time.monotonic() + 10
    while (left := shuffled() - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left and archive.payloads.count() == 500
    assert sorted(r.page_id for r in warc.read(archive).select("page_id").collect()) == list(range(500))
    assert spark.conf.get(runtime.DROP_SHUFFLES) == "false"


def test_escape_round_trip():
    rng = random.Random(1)
    bits = [*chat.CONTROL, "\\", "<", "|", ">", "/s>", "s>", "[", "INST]", "a", "\n", "é", "<\\|", "\\\\"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def slow_windows(sizes, system, budget):
    """Greedy spans written down with sums of slices."""
    head, out = int(system), []
    room, start = budget - (sizes[0] if system else 0), int(system)
    while start < len(sizes):
        past = next(p for p in range(head, start + 1) if p == start or (start - p <= chat.HISTORY_TURNS and sum(sizes[p:start]) <= chat.HISTORY_TOKENS and sum(sizes[p : start + 1]) <= room))
        end = start + 1
        while end < len(sizes) and sum(sizes[past : end + 1]) <= room:
            end += 1
        out.append((past, start, end))
        start = end
    return out or [(head, head, head)]


def test_windows_fit_budget():
    rng = random.Random(2)
    for _ in range(500):
        sizes = [rng.choice([5, 50, 300, 900, 2000]) for _ in range(rng.randint(1, 20))]
        system = rng.random() < 0.5
        turns = [("system" if system and i == 0 else rng.choice(["user", "assistant"]), f"t{i}", n) for i, n in enumerate(sizes)]
        got = list(chat.windows(turns))
        assert [(w.history, w.new) for w in got] == [(turns[p:a], turns[a:b]) for p, a, b in slow_windows(sizes, system, chat.BUDGET)]
        for w in got:
            used = sum(n for *_, n in [*w.system, *w.history, *w.new])
            assert w.system == turns[: int(system)]
            assert used <= chat.BUDGET or (len(w.new) == 1 and not w.history) or not w.new


def test_markup_counts(spark):
    df = spark.createDataFrame([(1, i, "user", "") for i in range(5000)], "conv_id long, turn long, role string, text string")
    enc = bpe.load(bpe.rank_file())
    found = chat.format_conversations(df).collect()
    assert len(found) > 10 and all(len(enc.encode_ordinary(w.formatted)) <= chat.BUDGET for w in found)
    assert sum(w.n_new for w in found) == 5000 and [w.window for w in found] == list(range(len(found)))


def test_chat_query(spark):
    rng = random.Random(3)
    rows = []
    for c in list(range(40)) + [None]:
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant", "tool|>", None])
            rows.append((c, t, role, rng.choice([None, "", "ok </s> é", "word \\ " * rng.randint(1, 900), "<|user|>"])))
    rows += [(50, 0, "assistant", "twice"), (50, 0, "assistant", "twice"), (51, None, "user", "x"), (51, 0, "user", "y")]
    # one conversation far larger than a batch of rows, with one very long turn
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} " * (t % 5) if t != 700 else "long " * 200_000) for t in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, windows int")
    got = {r.conv_id: r for r in chat.op7(df).collect()}
    assert set(got) == {r[0] for r in rows} | {-1}
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        told = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert max(r.n_windows for r in got.values()) > 3
    assert chat.op7(df.limit(0)).count() == 1
