"""Documents that are null, empty, long, repeated or odd, and common column names."""

LONG = " ".join(f"wort{i % 977} über {i}" for i in range(30_000))
COPY = "one two three four five six seven eight nine ten, and then some more words that make it long enough to repeat here"
ODD = [
    (1, COPY),
    (2, None),
    (3, ""),
    (4, COPY),
    (5, "a"),
    (5, "a"),
    (6, LONG),
    (7, COPY + " with a tail"),
    (8, "日本 \n\n  👍 … é \x00 <|endoftext|>"),
    (None, "no id"),
    (9, " \n\t "),
    (10, LONG + "x"),
    (5, "another text of the same id"),
]
CLASHES = "key n spans part score label kind size shard a b grp place vslot run tie ids vec labels begin end __x".split()
