from loomwork.llm import chat_quotes as C

MESSAGES = [
    (1, 0, "user", "Hello there\n\nSecond  thought"),
    (1, 1, "assistant", "> hello THERE\n\nHi!"),
    (1, 2, "user", "> second thought\n\nMore on that"),
    (1, 3, "assistant", "> > hello there\n> Hi!\nok"),
    (1, 4, "user", ">> never said\nfive"),
    (1, 5, "assistant", None),
    (1, 5, "assistant", None),
    (2, 0, "user", "Hello there"),
    (2, 9, None, ">Hello there\n>>deep\n\n>  \n"),
    (3, 4, "user", ""),
    (None, 1, "user", "x"),
    (4, None, "user", "x"),
]


def plain(rows):
    best = {}
    for c, t, r, x in rows:
        if c is not None and t is not None:
            best[c, t] = min(best.get((c, t), (r or "", x or "")), (r or "", x or ""))
    out = {}
    for c in {k[0] for k in best}:
        turns = sorted(t for k, t in best if k == c)
        up = {}
        for n, t in enumerate(turns):
            quotes = {(d, C.normalised(p)) for d, p in C.passages(best[c, t][1]) if d}
            source = {}
            for d, p in quotes:
                hits = [u for u in turns if u < t and (0, p) in {(e, C.normalised(q)) for e, q in C.passages(best[c, u][1])}]
                source[d, p] = max(hits) if hits else None
            linked = [(-d, s) for (d, p), s in source.items() if s is not None]
            up[t] = max(linked)[1] if linked else (turns[n - 1] if n else None)
            out[c, t] = [len(quotes), len(linked), up[t]]
        for t in turns:
            root, depth = t, 0
            while up[root] is not None:
                root, depth = up[root], depth + 1
            out[c, t] += [root, depth]
        for n, t in enumerate(sorted(turns, key=lambda t: (out[c, t][3], out[c, t][4], t))):
            out[c, t] += [n + 1]
    return {k: tuple(v) for k, v in out.items()}


def test_links_match_a_plain_loop(spark):
    many = MESSAGES + [(7, t, "user", f"m{t}\n> m{t * t % 17 % max(t, 1)}") for t in range(40)]
    rows = C.link_quotes(spark.createDataFrame(many, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to, r.root, r.depth, r.position) for r in rows} == plain(many)
    text = {(r.conv_id, r.turn): r.text for r in rows}
    assert text[1, 0] == "Hello there\n\nSecond  thought" and text[1, 1] == "Hi!" and text[1, 3] == "ok" and text[2, 9] == ""


def test_empty_and_order(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.link_quotes(none).count() == 0
    linked = C.link_quotes(spark.createDataFrame(MESSAGES, none.schema))
    rows = [(r.conv_id, r.position) for r in C.transcripts(linked).collect()]
    assert rows == sorted(rows)
    assert "text" not in C.digest(linked).columns
