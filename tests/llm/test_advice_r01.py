"""What the first review found missing."""

import numpy as np

from tidepool.llm import htmltext, jaccard


def passage_pairs(pairs, share, rng, near=0.8):
    """Embeddings of pairs of sets at Jaccard near, where one passage makes up about share of every set; rows shuffled."""
    def least(rate, shape):
        return rng.exponential(1 / rate, shape), rng.integers(0, 1 << 32, shape, np.uint32)

    n = jaccard.POSITIONS
    both = [least(share, (1, n)), least(near - share, (pairs, n))]
    one = [least((1 - near) / 2, (pairs, n)) for _ in range(2)]
    sigs = []
    for own in one:
        at = np.stack([np.broadcast_to(v, (pairs, n)) for v, _ in (*both, own)]).argmin(0)
        sigs.append(np.choose(at, [np.broadcast_to(t, (pairs, n)) for _, t in (*both, own)]))
    order = rng.permutation(2 * pairs)
    where = np.empty(2 * pairs, np.int64)
    where[order] = np.arange(2 * pairs)
    return np.concatenate(sigs)[order], where[:pairs], where[pairs:]


def test_shared_passage_loses_no_pairs():
    """A node of sets that share a passage, but are mostly not near each other, parts hardly any near pair."""
    for share in (0.35, 0.45):
        for seed in range(3):
            sigs, a, b = passage_pairs(1500, share, np.random.default_rng(seed))
            label = np.arange(len(sigs))
            for x, y in jaccard.chosen_paths(np.arange(len(sigs)), sigs, (), 0.5, np.random.default_rng(seed)):
                label = jaccard.tie(label, np.array([x]), np.array([y]))
            assert (label[a] != label[b]).mean() <= 0.02  # 0.2 ** 4 at each of some levels


def test_no_node_goes_whole_to_one_task(spark):
    """Near copies of one text, and sets that share a passage: every node is bounded, and no pair is lost."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, jaccard.POSITIONS, np.uint32)
    copies = np.where(rng.random((1500, jaccard.POSITIONS)) < 0.85, base, rng.integers(0, 1 << 32, (1500, jaccard.POSITIONS), np.uint32))
    sigs, a, b = passage_pairs(700, 0.45, rng)
    sigs = np.concatenate([sigs, copies])
    reps = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "id long, sig binary")
    nodes, _, _ = jaccard.bounded_nodes(reps, 0.8, 1e-6, 200)
    assert max(r["count"] for r in nodes.groupBy("key").count().collect()) <= 460
    label = np.arange(len(sigs))
    x, y = np.array([tuple(r) for r in jaccard.candidate_links(reps, 0.8, 1e-6, 200).collect()]).T
    label = jaccard.tie(label, x, y)
    assert (label[a] == label[b]).all()
    assert len(np.unique(label[len(a) + len(b):])) == 1


LONG = "A sentence of the article that goes on for quite a while, with words enough to fill some lines of a page. " * 6


def test_layout_names_keep_the_article():
    text = "\n".join([LONG.strip()] * 4)
    body = f"<p>{LONG}</p>" * 4
    ad = "<div class='ad'>Buy now, today only.</div>"
    for page in (f"<div class='layout has-sidebar'>{body}{ad}</div>", f"<div id='page' class='no-ads'>{body}{ad}</div>",
                 f"<div class='sidebar'>{body}{ad}</div>", f"<div class='widget'><article>{body}{ad}</article></div>",
                 f"<article><p>{LONG}</p><section class='related-work'>{body[:-len(body) // 4]}</section>{ad}</article>"):
        assert htmltext.main_text(f"<html><body>{page}</body></html>") == text
    assert htmltext.main_text(f"<body><article>{body}</article><div class='comments'>{body}</div>{ad}</body>") == text
    assert htmltext.main_text(f"<body><div>{body}</div><div class='site-footer'><p><a href='/'>All rights</a></p></div>{ad}</body>") == text


def test_regions_keep_lists_and_short_paragraphs():
    """Pages with and without an article: lines between the first and the last dense line of the content stay."""
    long = f"<p>{LONG}</p>"
    items = "".join(f"<li>Item {i} of the list." for i in range(5))
    talk = "".join(f"<p>Yes, said person {i}.</p>" for i in range(12))
    refs = "".join(f"<li><a href='/{i}'>Reference number {i}</a></li>" for i in range(4))
    nav = "".join(f"<div><a href='/{i}'>Place {i}</a></div>" for i in range(15))
    kept = [*[LONG.strip()] * 3, *(f"Item {i} of the list." for i in range(5)), LONG.strip(), *(f"Yes, said person {i}." for i in range(12)), LONG.strip(),
            *(f"Reference number {i}" for i in range(4)), LONG.strip()]
    body = f"{long * 3}<ul>{items}</ul>{long}{talk}{long}<ul>{refs}</ul>{long}"
    for tag in ("div", "article"):
        assert htmltext.main_text(f"<html><body>{nav}<{tag}>{body}</{tag}>{nav}</body></html>").split("\n") == kept
