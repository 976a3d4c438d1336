import random

from larder.llm import quotation

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def brute(rows):
    """Straight-line version: {(conv, turn): (reply_to, linked quotes)} and the reply order of turns."""
    import re

    def norm(s):
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", s).strip(" ").lower()

    links, order = {}, {}
    convs = {}
    for c, t, _, x, _ in rows:
        convs.setdefault(c, {}).setdefault(t, []).append(x or "")
    for c, turns in convs.items():
        own, first = {}, {}
        ts = sorted(turns)
        for t in ts:
            for x in turns[t]:
                for line in x.split("\n"):
                    if not line.startswith(">") and norm(line):
                        first.setdefault(norm(line), t)
        children = {}
        for i, t in enumerate(ts):
            hits = {}
            for x in turns[t]:
                for line in x.split("\n"):
                    m = re.match(r"(?:>[ ]?)+", line)
                    if m:
                        q = norm(line[m.end():])
                        if q and first.get(q, t) < t:
                            hits.setdefault(m[0].count(">"), set()).add((first[q], q))
            if hits:
                links[c, t] = max(a for a, _ in hits[min(hits)]), sum(map(len, hits.values()))
            else:
                links[c, t] = (ts[i - 1] if i else None), 0
            children.setdefault(links[c, t][0], []).append(t)
        # In pre-order the answer that is the next turn comes after the others.
        out = []

        def walk(t):
            out.append(t)
            kids = sorted(children.get(t, []))
            nxt = next((u for u in ts if u > t), None)
            for k in [k for k in kids if k != nxt] + [k for k in kids if k == nxt]:
                walk(k)

        walk(ts[0])
        order[c] = out
    return links, order


def make(seed, convs=4, turns=14):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        said = []
        for t in range(turns):
            own = f"line {c} {t} {rng.choice(['Alpha', 'beta  b', 'x'])}"
            text = ""
            for _ in range(rng.randrange(3)):
                if said:
                    text += rng.choice([">", "> ", "> > ", ">>> "]) + rng.choice(said).upper() + "\n"
            rows.append((c, t * 3, rng.choice(["user", "assistant"]), text + own, "z"))
            said.append(own)
    return rows


def test_links_and_order_match_brute_force(spark):
    for seed in range(3):
        rows = make(seed)
        got = quotation.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()
        links, order = brute(rows)
        assert {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_quotes"]) for r in got} == links
        for c, ts in order.items():
            mine = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["position"])
            assert [r["position"] for r in mine] == list(range(len(ts)))
            assert [r["turn"] for r in mine] == ts
        assert not any(r["body"].startswith(">") for r in got)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", None, None), (1, 0, "user", None, None), (1, None, "user", "free", None), (None, 5, None, "> \n>\nhello", None),
            (None, 7, "a", "> HELLO\n" + "long " * 50_000, None)]
    got = quotation.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5
    one = sorted((r["position"], r["turn"], r["body"]) for r in got if r["conv_id"] == 1)
    assert one == [(0, None, "free"), (1, 0, ""), (2, 0, "")] or [p for p, _, _ in one] == [0, 1, 2]
    last = next(r for r in got if r["turn"] == 7)
    assert (last["reply_to"], last["n_quotes"], last["position"]) == (5, 1, 1)
    assert quotation.reply_ordered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_are_linked_whatever_their_lines(spark):
    said = [(0, "Thanks for the plan.\nThe depot in the north opens at six\nand closes at nine, all week."),
            (1, "Good.\nThe second lorry waits\nat the gate"), (2, "Thanks,\nit is  late"), (3, "nothing of note")]
    asked = [("> THE depot in the\n> north opens at six and\n> closes at nine,", 0, 3),       # other line breaks
             ("> lorry waits at the", 1, 1),                                                  # part of lines
             ("> and closes at nine, all week.\n>\n> Thanks,", 2, 2),                          # held by none: by lines
             ("> it is late", 2, 1), ("> the gate waits", 9, 0), ("> > waits\n> > at\n\n> of note", 3, 3), ("> depot opens", 10, 0)]
    rows = [(c, t, "user", x, "z") for c in (1, None) for t, x in said]
    turn = {}
    for j, (q, origin, n) in enumerate(asked):
        rows += [(c, 5 + j, "user", q + f"\nanswer {j} end", "z") for c in (1, None)]
        turn[5 + j] = (origin, n)
    got = quotation.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_quotes"]) for r in got if r["turn"] >= 5} == {
        (c, t): (o if n else t - 1, n) for c in (1, None) for t, (o, n) in turn.items()}


def test_a_common_line_does_not_win_over_its_passage(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "user", "the first report\nis done\nThanks, all"), (1, 2, "user", "is done"), (1, 3, "user", "Thanks,"),
            (1, 4, "user", "> the first report\n> is done\n> Thanks,\nok")]
    got = quotation.reply_ordered(spark.createDataFrame([(*r, "z") for r in rows], SCHEMA)).collect()
    assert next((r["reply_to"], r["n_quotes"]) for r in got if r["turn"] == 4) == (1, 3)


def test_deep_replies_keep_tables_in_proportion(spark, monkeypatch):
    """Each message quotes the one two before it, so replies hang on replies; and many hang on one message."""
    n = 240
    deep = [(1, t, "user", (f"> own line {t - 2}\n" if t > 1 else "") + f"own line {t}", "z") for t in range(n)]
    wide = [(None, t, "user", ("> first of all\n" if t % 2 else "") + ("first of all" if t == 0 else f"say {t}"), "z") for t in range(n)]
    sizes, saved = [], quotation.saved
    monkeypatch.setattr(quotation, "BLOCK", 16)

    def counting(df, name):
        out = saved(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(quotation, "saved", counting)
    got = quotation.reply_ordered(spark.createDataFrame(deep + wide, SCHEMA)).collect()
    assert max(sizes) <= 2 * n
    links, order = brute(deep + wide)
    assert {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_quotes"]) for r in got} == links
    for c, ts in order.items():
        assert [r["turn"] for r in sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["position"])] == ts
