import random

WORDS = ["alpha", "beta", "gamma", "delta", "house", "river", "stone", "light", "paper", "green", "summer", "winter", "music", "letter", "garden", "window", "bridge", "forest", "silver", "number"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))
