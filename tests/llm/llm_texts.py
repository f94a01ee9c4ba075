"""Texts that an operator may stumble over."""

import random

LONG = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta", "Epsilon,", "zeta."]) + str(random.Random(i).randint(0, 999)) for i in range(30_000))
PASSAGE = "This very passage, of well over fifty bytes, stands word for word in several texts."
TEXTS = [
    (1, PASSAGE + " one two three four five six seven eight nine ten"),
    (2, "Before it comes something. " + PASSAGE),
    (3, PASSAGE + " one two three four five six seven eight nine ten"),
    (3, PASSAGE + " one two three four five six seven eight nine ten"),
    (4, ""),
    (5, None),
    (6, " \n\t  "),
    (None, "A text without a number. " + PASSAGE),
    (7, LONG),
    (8, LONG + " " + "x" * 3000),
    (9, "Released under the MIT License. mit license mit license\nLicensed under CC BY-NC 4.0."),
    (10, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"),
    (11, "日本語 テキスト 😀 é ñ  two  spaces \n\n <|endoftext|> <s> ▁ \x00 end"),
    (12, "\n".join(["the same line of words here"] * 8 + [f"line {w} of a longer text with more words" for w in "abcdefgh"])),
    (13, "you idiot trash scum moron loser " * 4),
    (14, "fine words only and nothing else at all " * 4),
]
