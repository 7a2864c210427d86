"""Rules of the detectors: what fires, how strongly, and for which assistant.

Everything here is a fixed value: patterns (in the ECMAScript dialect, see functions.rx), word lists, weights and
thresholds that the results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches make a signal once there are `least` of them, in the whole text, its head or its tail."""

    id: str
    pattern: str
    strength: str
    points: int
    flags: str = ""
    vendors: tuple[tuple[str, int], ...] = ()
    least: int = 1
    zone: str = "all"
    skip: tuple[str, ...] = ()
    #: Every match holds one of these, in lower case where letters fold; empty: nothing is known. Spares looking for what can't be there.
    needs: tuple[str, ...] = ()


HEAD_CHARS, TAIL_CHARS = 300, 600
CATEGORIES = ("project", "metadata", "artefact", "unicode", "model", "code", "style", "stats", "watermark")
TECHNICAL = ("project", "metadata", "artefact", "unicode")
STRENGTHS = ("fort", "moyen", "faible", "info")
STRENGTH_FACTOR = {"fort": 3.0, "moyen": 2.0, "faible": 1.0, "info": 0.5}

# fixed values: markers that assistants leave in copied text
ARTEFACTS = (
    Rule("art-oaicite", r":?contentReference\[oaicite:\d+\](\{index=\d+\})?|\boaicite:\d+", "fort", 45, vendors=(("chatgpt", 3),), needs=("oaicite:",)),
    Rule("art-oai-brackets", r"【\d+(?::\d+)?†[^】\n]{0,60}】", "fort", 45, vendors=(("chatgpt", 3),), needs=("【",)),
    Rule("art-citeturn", r"\b(?:cite|filecite|navlist)?turn\d+(?:search|news|view|fetch|file|image|academia|forecast|finance|product)\d+\b|\bfilecite\b", "fort", 45, vendors=(("chatgpt", 3),), needs=("turn", "filecite")),
    Rule("art-oai-images", r"""\bimages\.openai\.com\/(?:static-rsc-\d+|thumbnails)\/[^\s)\]"'>]+""", "fort", 45, vendors=(("chatgpt", 3),), needs=("images.openai.com",)),
    Rule("art-gemini-cite", r"\[cite_start\]|\[cite:\s*[\d,\s-]+\]", "fort", 45, vendors=(("gemini", 3),), needs=("[cite",)),
    Rule("art-claude-tags", r"""<\/?(?:antml:[a-z_]+|antArtifact|cite index="[^"]*")[^>]*>""", "fort", 40, vendors=(("claude", 3),), needs=("antml:", "antArtifact", "cite index=")),
    Rule("art-deepseek-cite", r"\[citation:\s?\d+\]", "fort", 45, vendors=(("deepseek", 3),), needs=("[citation:",)),
    Rule("art-think", r"<\/?think>", "fort", 45, vendors=(("deepseek", 2), ("qwen", 2),), needs=("think>",)),
    Rule("art-copilot-cite", r"\[\^\d+\^\]", "fort", 40, vendors=(("copilot", 3),), needs=("[^",)),
    Rule("art-grok-render", r"""<\/?grok:render[^>]*>|<argument name="citation_id">""", "fort", 45, vendors=(("grok", 3),), needs=("grok:render", "citation_id")),
    Rule("art-numeric-cites", r"(?:\[\d{1,2}\]){2,}", "faible", 6, vendors=(("perplexity", 1),), least=2, needs=("][",)),
    Rule("art-share-link", r"(?:chatgpt\.com|chat\.openai\.com)\/(?:share|c)\/[\w-]+|(?:gemini\.google\.com\/(?:share|app)|g\.co\/gemini\/share)\/[\w-]+|claude\.ai\/(?:share|chat)\/[\w-]+|chat\.deepseek\.com\/[\w\/-]+|perplexity\.ai\/(?:search|page)\/[\w-]+|grok\.com\/(?:share|chat)\/[\w-]+|x\.com\/i\/grok[\w\/?=-]*|copilot\.microsoft\.com\/[\w\/-]+|chat\.mistral\.ai\/[\w\/-]+|(?:www\.)?meta\.ai\/[\w\/-]+|chat\.qwen\.ai\/[\w\/-]+", "fort", 35, flags="i", needs=("chatgpt.com/", "chat.openai.com/", "gemini.google.com/", "g.co/gemini/", "claude.ai/", "chat.deepseek.com/", "perplexity.ai/", "grok.com/", "x.com/i/grok", "copilot.microsoft.com/", "chat.mistral.ai/", "meta.ai/", "chat.qwen.ai/")),
    Rule("art-self-vendor", r"(?:je suis|i am|i['’]m)\s+(?:chat\s?gpt|claude|gemini|copilot|le chat|(?:mistral\s)?vibe|deepseek|grok|meta ai|qwen)\b|(?:développée?|créée?|conçue?|entraînée?) par (?:openai|anthropic|google|microsoft|mistral(?: ai)?|deepseek|xai|meta|alibaba)\b|(?:developed|created|trained|built) by (?:openai|anthropic|google|microsoft|mistral(?: ai)?|deepseek|xai|meta|alibaba)\b", "fort", 40, flags="i", needs=("gpt", "claude", "gemini", "copilot", "le chat", "vibe", "deepseek", "grok", "meta", "qwen", "openai", "anthropic", "google", "microsoft", "mistral", "xai", "alibaba")),
    Rule("art-self-ai", r"\b(?:as an ai(?: language model)?|as a large language model|i(?: am|'m) an ai\b|my (?:training data|knowledge cut-?off)|i (?:don't|do not) have (?:access to )?(?:real-time|the internet|browsing))|en tant qu['’](?:ia|intelligence artificielle|assistant(?:e)? (?:virtuel|ia))|en tant que modèle de langage|je suis (?:une? )?(?:ia|intelligence artificielle|modèle de langage|assistant virtuel)\b|mes données d['’]entraînement|(?:ma )?date (?:limite|de coupure) (?:de mes |des )?connaissances|je n['’]ai pas accès à (?:internet|des informations en temps réel)", "fort", 40, flags="i", needs=("an ai", "large language model", "training data", "knowledge cut", "real-time", "the internet", "browsing", "en tant qu", "je suis ", "mes données", "connaissances", "pas accès")),
    Rule("art-refusal", r"\b(?:i'?m sorry|je suis désolée?),?\s+(?:but\s+)?(?:i can(?:'|no)t|i cannot|je ne peux pas)\s+(?:help|assist|provide|aider|répondre|fournir|générer)", "fort", 30, flags="i", needs=("m sorry", "je suis désol")),
    Rule("art-opening", r"^\s*(?:(?:bien sûr|absolument|certainement|excellente question|très bonne question|avec plaisir|parfait|super)\s*[!,.]?\s*(?:voici|je vais|ci-dessous|voilà)|voici (?:une?|la|le|les|ta|votre|ton|vos|tes) (?:version|proposition|exemple|liste|résumé|texte|lettre|réponse|réécriture|correction|reformulation|traduction|mail|e-?mail|plan|synthèse)|(?:certainly|sure|absolutely|of course|great question)[!,.]?\s*(?:here(?:'s| is| are)|below)|here(?:'s| is) (?:a|an|the|your) (?:revised|rewritten|polished|improved|draft|version|summary|example|list))", "moyen", 22, flags="i", zone="head"),
    Rule("art-closing", r"n['’]hésite[sz]? pas à (?:me )?(?:demander|dire|faire savoir|revenir vers moi)|j['’]espère que (?:cela|ça|ceci) (?:vous|t['’]) ?(?:aide|aidera|sera utile|conviendra)|(?:souhaite[sz]?|voulez|veux)[- ](?:vous|tu) que je|tu veux que je|dis-moi si tu (?:veux|souhaites|préfères)|dites-moi si vous (?:voulez|souhaitez|préférez)|je peux aussi (?:te|vous) (?:proposer|préparer|faire|rédiger)|si tu (?:le )?veux,? je peux|si vous le souhaitez,? je peux|let me know if (?:you|there)|i hope this helps|feel free to (?:ask|reach out|let me know)|would you like me to|do you want me to|if you(?:'d)? like,? i can|happy to help", "moyen", 22, flags="i", zone="tail"),
    Rule("art-placeholders", r"\[(?:votre|vos|ton|ta|tes|nom|prénom|date|adresse|entreprise|société|poste|insérer|insert|your|company|name|recipient|destinataire|numéro|téléphone|email|e-mail|ville|lieu|montant|titre)\b[^\]\n]{0,40}\]", "moyen", 15, flags="i", skip=("code",)),
    Rule("art-utm", r"utm_source=(?:chatgpt\.com|openai|perplexity(?:\.ai)?|copilot(?:\.com)?|gemini|claude(?:\.ai)?|bard|you\.com|mistral|deepseek|grok)", "fort", 45, flags="i", needs=("utm_source=",)),
    Rule("art-emoji-bullets", r"^[ \t]*(?:✅|❌|🚀|👉|📌|🔹|🔸|✨|💡|⚡|📊|🎯|🔥|🧠|📈|🛠\uFE0F|⚠\uFE0F|📝|🔍|💼|🌟|➡\uFE0F|✔\uFE0F|1\uFE0F\u20E3|2\uFE0F\u20E3|3\uFE0F\u20E3)", "faible", 8, flags="m", least=3),
    Rule("art-latex", r"\\\(|\\\)|\\\[|\\\]|\\frac\{|\\times\b|\\text\{|\\cdot\b|\\approx\b", "faible", 8, least=2, skip=("code", "md"), needs=("\\",)),
)
MARKDOWN = Rule("art-markdown", r"\*\*[^*\n]{2,80}\*\*|^#{1,4} \S.*$|^\s*(?:---|\*\*\*)\s*$|^```|^\|(?:\s*:?-{3,}:?\s*\|)+\s*$", "moyen", 12, flags="m", least=2, skip=("md", "code"), needs=("**", "# ", "---", "```", "|"))
HIDDEN_UTM = r"utm_source=(chatgpt|openai|perplexity|copilot|gemini|claude|you\.com)"
#: Rules whose assistants are read from the matches, with this weight.
FROM_MATCH, FROM_MATCH_WEIGHT = ("art-utm", "art-share-link", "art-self-vendor"), 3
#: Markers of so many assistants in one text: it writes about them, and the markers count for this many points together.
SIGNATURES = ("art-oaicite", "art-oai-brackets", "art-oai-images", "art-citeturn", "art-gemini-cite", "art-claude-tags", "art-deepseek-cite", "art-think", "art-copilot-cite", "art-grok-render")
DISCUSSION_VENDORS, DISCUSSION_POINTS = 3, 15

# fixed values: assistants in the order of reports, and patterns by which a text names them, first match first
AI_VENDORS = ("chatgpt", "claude", "gemini", "copilot", "mistral", "deepseek", "perplexity", "grok", "meta", "qwen")
VENDOR_PATTERNS = (
    (r"chat\s?gpt|openai|\bgpt-?(3|4|5|4o|o\d)\b|\bdall-?e\b|\bsora\b", "chatgpt"),
    (r"\bclaude\b|anthropic", "claude"),
    (r"\bgemini\b|\bbard\b|google\s*(ai\s*studio|deepmind)|notebooklm", "gemini"),
    (r"copilot|bing\s*chat", "copilot"),
    (r"perplexity", "perplexity"),
    (r"mistral|le\s?chat\b", "mistral"),
    (r"deepseek", "deepseek"),
    (r"\bgrok\b|\bx\.ai\b|\bxai\b", "grok"),
    (r"meta\s?ai|\bllama\b", "meta"),
    (r"\bqwen\b|tongyi", "qwen"),
)
PUBLISHERS = (
    (r"openai|chat\.openai", "chatgpt"),
    (r"anthropic", "claude"),
    (r"google|g\.co\/gemini", "gemini"),
    (r"microsoft", "copilot"),
    (r"mistral", "mistral"),
    (r"x\.com\/i\/grok|\bxai\b", "grok"),
    (r"meta\.ai|\bmeta\b", "meta"),
    (r"alibaba|qwen", "qwen"),
)

# fixed values: characters that do not show
ZERO_WIDTH = r"[\u200B\u200C\u2060\u180E]"
ZWJ, BOM = "\u200d", "\ufeff"
EMOJI_TAIL = r"[\uDC00-\uDFFF\uFE0F\u2600-\u27BF]"
PICTOGRAPHS = r"\u00A9\u00AE\u203C\u2049\u2122\u2139\u2194-\u2199\u21A9\u21AA\u231A\u231B\u2328\u2388\u23CF\u23E9-\u23F3\u23F8-\u23FA\u24C2\u25AA\u25AB\u25B6\u25C0\u25FB-\u25FE\u2600-\u27BF\u2934\u2935\u2B05-\u2B07\u2B1B\u2B1C\u2B50\u2B55\u3030\u303D\u3297\u3299"
PRIVATE_CITATION = r"[\uE200-\uE2FF]"
TAGS = r"[\u{E0000}-\u{E007F}]+"
VARIATION = r"(?<![" + PICTOGRAPHS + r"\uDC00-\uDFFF\u20E3#*0-9])[\uFE00-\uFE0F]|[\u{E0100}-\u{E01EF}]"
ANY_VARIATION = r"[\uFE00-\uFE0F\u{E0100}-\u{E01EF}]"
NARROW_SPACE = r"\u202F"
NARROW_SPACE_FR = r"(?<![«0-9])\u202F(?![;:!?»%€$0-9])"
BIDI = r"[\u202A-\u202E\u2066-\u2069]"
LETTERS, LATIN, LOOKALIKE = r"\p{L}+", r"\p{Script=Latin}", r"[\p{Script=Cyrillic}\p{Script=Greek}]"
#: All look-alike letters are among these, and few others.
MAY_LOOK_ALIKE = r"[^\u0000-\u036F\u2000-\u206F]"

# fixed values: expressions that language models overuse
LEXICON_FR = (
    r"il est (?:important|essentiel|crucial|primordial|fondamental|utile) de (?:noter|souligner|comprendre|rappeler|garder à l['’]esprit|reconnaître)",
    r"il convient de (?:noter|souligner|rappeler|mentionner)",
    r"dans un monde en (?:constante|perpétuelle|pleine) (?:évolution|mutation)",
    r"en (?:constante|perpétuelle) évolution",
    r"à l['’]ère (?:du numérique|de l['’]intelligence artificielle|digitale|moderne|actuelle)",
    r"dans le paysage (?:actuel|numérique|économique|professionnel|technologique)",
    r"plong(?:er|eons|ez|eant) (?:dans|au cœur)",
    r"naviguer (?:dans|à travers|entre) (?:les|la|le|ce|cet|cette|l['’])",
    r"véritables? (?:levier|atout|pilier|moteur|catalyseur|tremplin|trésor|joyau|vecteur)s?",
    r"un atout (?:majeur|précieux|indéniable|incontournable|considérable)",
    r"jou(?:e|ent|ant) un rôle (?:clé|crucial|essentiel|central|déterminant|majeur|primordial|fondamental)",
    r"incontournables?",
    r"cruci(?:al|ale|aux|ales)",
    r"primordiale?s?",
    r"témoign(?:e|ent|ant) d[eu]",
    r"riches? et (?:variée?s?|diversifiée?s?)",
    r"synergies?",
    r"holistiques?",
    r"leviers?",
    r"en (?:somme|résumé|définitive|conclusion)",
    r"pour (?:conclure|résumer)",
    r"(?:de plus|en outre|par ailleurs),",
    r"au cœur (?:de|des|du)",
    r"mett(?:re|ant|ent) en (?:lumière|avant|exergue)",
    r"soulign(?:e|ent|ant) l['’]importance",
    r"que vous soyez",
    r"que ce soit pour",
    r"(?:découvrons|explorons|voyons ensemble)",
    r"dans cet article,? (?:nous|je) (?:allons|verrons|vous)",
    r"points? clés?",
    r"à retenir",
    r"tisse(?:r|nt)? (?:des|un|une|les)",
    r"tapisserie",
    r"foisonnante?s?",
    r"pierre angulaire",
    r"(?:un|une) approche (?:holistique|globale|intégrée|proactive)",
    r"fort(?:e)? de (?:mon|ma|mes) (?:expérience|parcours|compétences)",
    r"c['’]est avec (?:un (?:grand|vif|réel) (?:intérêt|enthousiasme)|enthousiasme)",
    r"je suis convaincue? que (?:mon|ma|mes)",
    r"force de proposition",
    r"valeur ajoutée",
    r"en (?:perpétuel|plein) essor",
    r"optimale?s?",
    r"fluidifier",
    r"booster",
)
LEXICON_EN = (
    r"delv(?:e|es|ed|ing)",
    r"tapestry",
    r"testament to",
    r"intricate(?:ly)?",
    r"meticulous(?:ly)?",
    r"pivotal",
    r"underscor(?:e|es|ed|ing)",
    r"showcas(?:e|es|ed|ing)",
    r"realm",
    r"ever-evolving",
    r"(?:evolving|digital|modern|competitive) landscape",
    r"navigat(?:e|ing) the (?:complexities|challenges|world|landscape)",
    r"embark(?:s|ed|ing)? on",
    r"foster(?:s|ed|ing)?",
    r"leverag(?:e|es|ed|ing)",
    r"seamless(?:ly)?",
    r"elevat(?:e|es|ed|ing)",
    r"harness(?:es|ed|ing)?",
    r"multifaceted",
    r"nuanced",
    r"paramount",
    r"holistic",
    r"synerg(?:y|ies)",
    r"in today['’]s (?:fast-paced|digital|ever|modern|rapidly)",
    r"it(?:['’]s| is) (?:important|worth|crucial|essential) (?:to note|noting|to remember|to consider)",
    r"in (?:conclusion|summary)",
    r"(?:furthermore|moreover|additionally),",
    r"play(?:s|ed|ing)? a (?:crucial|pivotal|vital|key|significant) role",
    r"sh(?:ed|eds|edding) light on",
    r"stands? as a",
    r"boasts?",
    r"nestled",
    r"vibrant",
    r"bustling",
    r"game[- ]changer",
    r"(?:let['’]s )?dive (?:into|deeper)",
    r"a rich (?:tapestry|history|heritage)",
    r"commendable",
    r"noteworthy",
    r"invaluable",
    r"unwavering",
    r"cutting-edge",
    r"robust",
    r"crucial",
)

#: Every match of the expressions holds one of these, in lower case.
LEXICON_FR_NEEDS = (
    "il est ", "il convient de ", "dans un monde en ", "en constante évolution", "en perpétuelle évolution", "ère ", "dans le paysage ", "plonge", "naviguer ", "véritable", "un atout ", " un rôle ", "incontournable", "cruci",
    "primordial", "témoign", "riche", "synergie", "holistique", "levier", "en somme", "en résumé", "en définitive", "en conclusion", "pour conclure", "pour résumer", "de plus,", "en outre,", "par ailleurs,", "au cœur d",
    "en lumière", "en avant", "en exergue", "soulign", "que vous soyez", "que ce soit pour", "découvrons", "explorons", "voyons ensemble", "dans cet article", "point clé", "points clé", "à retenir", "tisse", "tapisserie", "foisonnant",
    "pierre angulaire", "approche ", " de mon ", " de ma ", " de mes ", "est avec ", "je suis convaincu", "force de proposition", "valeur ajoutée", " essor", "optimal", "fluidifier", "booster",
)
LEXICON_EN_NEEDS = (
    "delv", "tapestry", "testament to", "intricate", "meticulous", "pivotal", "underscor", "showcas", "realm", "ever-evolving", " landscape", "navigat", "embark", "foster", "leverag", "seamless", "elevat", "harness", "multifaceted",
    "nuanced", "paramount", "holistic", "synerg", "in today", "to note", "noting", "to remember", "to consider", "in conclusion", "in summary", "furthermore,", "moreover,", "additionally,", " role", "light on", "stand", "boast",
    "nestled", "vibrant", "bustling", "changer", "dive ", "a rich ", "commendable", "noteworthy", "invaluable", "unwavering", "cutting-edge", "robust", "crucial",
)

# fixed values: other marks of style
NOT_X_FR = r"(?<![\p{L}])(?:ce n['’]est pas|il ne s['’]agit pas) (?:seulement|simplement|juste|qu['’]une?) [^.!?\n]{1,80}|non seulement [^.!?\n]{1,100} mais|pas seulement [^.!?\n]{1,60},? mais"
NOT_X_EN = r"(?:it['’]?s|this is|that['’]?s) not (?:just|only|merely|simply) [^.!?\n]{1,60}[,;\u2014\u2013-]\s*(?:it['’]?s|but)|not only [^.!?\n]{1,100} but(?: also)?"
NOT_X_FR_NEEDS, NOT_X_EN_NEEDS = ("est pas ", "agit pas ", "non seulement ", "pas seulement "), ("not just ", "not only ", "not merely ", "not simply ")
TRANSITION = r"^(?:De plus|En outre|Par ailleurs|Ainsi|Enfin|En effet|En somme|En résumé|En conclusion|Furthermore|Moreover|Additionally|In addition|Overall|Ultimately|In conclusion)\b"
TRANSITION_NEEDS = ("De plus", "En outre", "Par ailleurs", "Ainsi", "Enfin", "En effet", "En somme", "En résumé", "En conclusion", "Furthermore", "Moreover", "Additionally", "In addition", "Overall", "Ultimately", "In conclusion")
LABEL_LIST = r"^\s*(?:[-*•▪]|\d{1,2}[.)])\s*\*{0,2}\p{Lu}[^:\n]{1,50}?\*{0,2}\s?:\s+\S"
CASUAL_FR = r"mdr|ptdr|lol|jsp|tkt|stp|bcp|pk|pcq|jpp|osef|wesh|chui|chuis|ouais|trkl|dsl|jsuis|j['’]sais|y['’]a|slt|bjr|cc|ahah+|haha+|hihi|xd|svp"
CASUAL_EN = r"lol|lmao|idk|tbh|imo|imho|gonna|wanna|kinda|gotta|omg|btw|u|ur|thx|pls"
REPEATED_PUNCTUATION = r"[!?]{2,}|\.{4,}"
LOWER_START = r"[.!?]\s+[a-zàâçéèêëîïôûùüÿœ]"
DOUBLE_SPACE = r"\S {2,}(?=\S)"
EM_DASH = "—"

# fixed values: words of a text, function words, list markers
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"
BULLET = r"^\s*([-*•▪◦·‣]|\d{1,2}[.)])\s+"
STOP_FR = "le la les des est et une un que pour dans qui pas du en sur au aux avec ce cette il elle nous vous ils sont être fait plus mais ou donc car ne se son sa ses leur".split()
STOP_EN = "the and is of to in that it for with as was on are this be by an at or from have has not but which you your they their will can".split()
