"""Word lists of the enrichment operators. All of them are fixed values."""

# Words that speak for or against something.
POSITIVE = (
    "admirable", "amazing", "awesome", "best", "better", "brilliant", "celebrate", "delight", "excellent",
    "fantastic", "good", "great", "happy", "hope", "improve", "joy", "love", "nice", "outstanding",
    "perfect", "pleased", "praise", "strong", "succeed", "success", "superb", "win", "wonderful",
)
NEGATIVE = (
    "angry", "attack", "awful", "bad", "clown", "corrupt", "crisis", "disaster", "disgusting", "fail",
    "failure", "fear", "hate", "idiot", "kill", "loser", "loss", "moron", "pathetic", "poor", "sad",
    "scum", "stupid", "terrible", "trash", "violent", "weak", "worse", "worst", "worthless", "wrong",
)

# Words a key phrase neither starts nor ends with.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but",
    "by", "can", "could", "did", "do", "for", "from", "had", "has", "have", "he", "her", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "more", "most", "my", "no", "not", "of", "on", "one",
    "or", "our", "out", "she", "so", "some", "than", "that", "the", "their", "them", "then", "there",
    "these", "they", "this", "to", "up", "was", "we", "were", "what", "when", "which", "who", "will",
    "with", "would", "you", "your",
)


def singles(*ranges: str) -> str:
    """The characters of ranges such as ``a-z``, one by one.

    Java tests a class of single characters below U+0100 with one bit set, a class of ranges with one
    predicate per range: several times slower on whole texts.
    """
    return "".join(chr(c) for r in ranges for c in range(ord(r[0]), ord(r[2]) + 1))


# Fixed value: the letters words are made of, after lower-casing.
LETTERS = singles("a-z", "à-ö", "ø-ÿ")
WORDS = f"[{LETTERS}]+"
