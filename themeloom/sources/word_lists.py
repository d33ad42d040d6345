"""Word lists that come with the package."""

# Irregular English forms and their lemmas. A form that is not
# listed is its own lemma.
IRREGULAR_LEMMAS = {
    "am": "be", "are": "be", "is": "be", "was": "be", "were": "be", "been": "be", "being": "be",
    "has": "have", "had": "have", "having": "have",
    "does": "do", "did": "do", "done": "do", "doing": "do",
    "says": "say", "said": "say", "saying": "say",
    "goes": "go", "went": "go", "gone": "go", "going": "go",
    "makes": "make", "made": "make", "making": "make",
    "takes": "take", "took": "take", "taken": "take", "taking": "take",
    "comes": "come", "came": "come", "coming": "come",
    "sees": "see", "saw": "see", "seen": "see", "seeing": "see",
    "gets": "get", "got": "get", "gotten": "get", "getting": "get",
    "gives": "give", "gave": "give", "given": "give", "giving": "give",
    "knows": "know", "knew": "know", "known": "know",
    "thinks": "think", "thought": "think", "thinking": "think",
    "tells": "tell", "told": "tell", "telling": "tell",
    "finds": "find", "found": "find",
    "leaves": "leave", "left": "leave", "leaving": "leave",
    "keeps": "keep", "kept": "keep",
    "holds": "hold", "held": "hold",
    "begins": "begin", "began": "begin", "begun": "begin",
    "brings": "bring", "brought": "bring",
    "writes": "write", "wrote": "write", "written": "write", "writing": "write",
    "runs": "run", "ran": "run", "running": "run",
    "wins": "win", "won": "win", "winning": "win",
    "loses": "lose", "lost": "lose", "losing": "lose",
    "men": "man", "women": "woman", "children": "child", "people": "person",
    "lives": "life", "wives": "wife", "countries": "country", "cities": "city",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad",
    "an": "a", "these": "this", "those": "that", "them": "they", "us": "we", "me": "i",
}
