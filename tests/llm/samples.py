"""Texts that strain tokenizers: case, marks, special strings, odd spaces, long runs."""

TEXTS = [
    None,
    "",
    " ",
    "\n",
    "it's  THE end'll İSTANBUL ΑΣ  <|endoftext|>x<|startoftext|>",
    "a\x1cb c\x85d e",
    "  lead  trail  ",
    "▁a ▁ b",
    "日本語テキスト 🤖🤖 élé aaaaaaaaaaaaaaaaaaaa",
    "tab\tnew\n\n\nline",
    "<s> </s> <unk> <0x0A> <|endoftext|",
    "1234567 ½ ²",
    "x" * 3000 + "yx" * 500,
    "don't''s !!!'s ,<|endoftext|>,",
    "ﬁ Å Å é ́ ​zw",
    "word, word; word. WORD? ÀÉ été: naïve!",
    "the same row",
    "the same row",
    "long " + "thanedble ouchan erwhing. " * 20000,
]
SCHEMA = "doc_id long, text string, ids string, row int"
ROWS = [(i, text, "x", i) for i, text in enumerate(TEXTS)] + [(None, "no id", None, None)]
