"""Fixed values of the developer profile: keywords, patterns of styles and themes, and of fact cards."""

# Words of programming languages, which are no identifiers of anybody's own.
CODE_KEYWORDS = (
    "if else elif for while def class return import from as with try except finally raise pass break continue and or not in is None True False self cls async await yield lambda "
    "global nonlocal assert del print int str float bool list dict set tuple type len range enumerate zip map filter var let const function new this null undefined void static "
    "public private protected abstract interface"
).split()
CODE_TAGS = ["code", "snippet", "implementation", "programming"]
CODE_MARKS = [r"def\s+\w+\s*\(", r"class\s+\w+", r"import\s+\w+", r"function\s+\w+", r"const\s+\w+\s*=", r"let\s+\w+\s*=", r"if\s*\(.*\)\s*\{", r"for\s*\(.*\)\s*\{"]

# Ways to deal with errors, each with the patterns that are counted for it.
ERROR_STYLES = {
    "try/except": [r"\btry\s*:"],
    "Result types": [r"\bResult\["],
    "assertions": [r"\bassert\b"],
    "error returns": [r"return\s+(?:None|False|\{\"error\")"],
    "custom exceptions": [r"class\s+\w+(?:Error|Exception)\b", r"\braise\b"],
}
DOCSTRING_STYLES = {
    "google": r"(?m)^\s*(?:Args|Returns|Raises|Yields|Note|Example):",
    "numpy": r"(?m)^\s*(?:Parameters|Returns|Raises)\s*\n\s*-{3,}",
    "sphinx": r":\s*(?:param|type|returns|rtype|raises)\s",
}
FUNCTIONS = r"def\s+\w+\s*\("
TYPED_RETURNS = r"def\s+\w+\s*\([^)]*\)\s*->"
TYPED_PARAMETERS = r":\s*(?:str|int|float|bool|list|dict|set|tuple|Optional|Any|None)\b"
TYPED_VARIABLES = r"(?m)^\s*\w+\s*:\s*(?:str|int|float|bool|list|dict|Optional|Any)\b"
# Where libraries are named, with the group of the name.
LIBRARY_MENTIONS = [r"(?:from|import)\s+([\w.]+)", r"pip\s+install\s+([\w\-]+)", r"(?:npm|yarn)\s+(?:install|add)\s+([\w@/\-]+)", r"(?m)^([\w\-]+)\s*[=><!]+"]

# Themes, each with the patterns that are counted for it; two matches make a theme.
ARCHITECTURE_THEMES = {
    "MVC": [r"\bMVC\b", r"\bmodel.view.controller\b"],
    "microservices": [r"\bmicroservice", r"\bservice.mesh\b", r"\bAPI.gateway\b"],
    "monolith": [r"\bmonolith\b", r"\bmonolithic\b"],
    "event-driven": [r"\bevent.driven\b", r"\bevent.sourcing\b", r"\bpub.?sub\b", r"\bmessage.queue\b"],
    "layered": [r"\blayered\b", r"\bthree.tier\b", r"\bn.tier\b"],
    "hexagonal": [r"\bhexagonal\b", r"\bports.and.adapters\b"],
    "CQRS": [r"\bCQRS\b", r"\bcommand.query\b"],
    "repository pattern": [r"\brepository.pattern\b", r"\bdata.access.layer\b"],
    "dependency injection": [r"\bdependency.injection\b", r"\bDI\b", r"\bIoC\b"],
    "facade pattern": [r"\bfacade\b"],
    "factory pattern": [r"\bfactory\b"],
    "singleton": [r"\bsingleton\b"],
    "observer pattern": [r"\bobserver.pattern\b", r"\bevent.listener\b"],
    "REST API": [r"\bREST\b", r"\bRESTful\b"],
    "GraphQL": [r"\bGraphQL\b"],
    "serverless": [r"\bserverless\b", r"\blambda\b", r"\bcloud.function\b"],
    "clean architecture": [r"\bclean.architecture\b", r"\buse.case\b"],
    "domain-driven design": [r"\bDDD\b", r"\bdomain.driven\b", r"\bbounded.context\b"],
    "TDD": [r"\bTDD\b", r"\btest.driven\b"],
    "CI/CD": [r"\bCI/?CD\b", r"\bcontinuous.integration\b", r"\bcontinuous.delivery\b"],
}
REVIEW_THEMES = {
    "naming consistency": [r"\bnaming\b", r"\bconsisten(?:t|cy)\b.*\bnam"],
    "missing tests": [r"\bmissing\s+tests?\b", r"\bno\s+tests?\b", r"\btest\s+coverage\b"],
    "error handling gaps": [r"\berror\s+handling\b", r"\bunhandled\b", r"\bmissing\s+except\b"],
    "documentation needed": [r"\bdocument(?:ation)?\b.*\bmissing\b", r"\bneeds?\s+docs?\b"],
    "type safety": [r"\btype\s+(?:safety|hint|annotation)\b", r"\bmissing\s+type\b"],
    "code duplication": [r"\bduplicat(?:e|ion)\b", r"\bDRY\b", r"\brepeat(?:ed|ing)\b"],
    "complexity concerns": [r"\bcomplex(?:ity)?\b", r"\bsimplif(?:y|ied)\b", r"\brefactor\b"],
    "performance issues": [r"\bperformance\b", r"\bslow\b", r"\boptimiz(?:e|ation)\b"],
    "security concerns": [r"\bsecurity\b", r"\bvulnerab(?:le|ility)\b", r"\binjection\b"],
    "API design": [r"\bAPI\s+design\b", r"\binterface\s+design\b", r"\bcontract\b"],
}
REVIEW_TAGS, REVIEW_TYPES = ["review", "feedback", "code-review", "pr"], ["observation", "decision"]

# What is avoided.
AVOIDED = r"(?i)(?:avoid|don't\s+use|never\s+use|stopped\s+using|moved\s+away\s+from|replaced|deprecated|anti.?pattern|bad\s+practice|shouldn't|prefer\s+not|dislike|hate|problematic)"
AVOIDED_TAGS = ["mistake", "anti-pattern", "avoid", "bad-practice"]
REJECTED = r"(?i)(?:instead\s+of|avoid|not\s+using|replaced|switched\s+from)\s+([\w\-]+)"

# Cards of facts: kind, and a pattern with one group (a value) or two (an attribute and a value, or a count and what is counted).
CARD_FORMS = [
    ("preference", r"\bI\s+(?:prefer|like|love|enjoy|use|own|bought|switched to|upgraded to)\s+(?:a |an |the |my )?(.+?)(?:\.|,|;|!|\n|$)"),
    ("fact", r"\bI(?:'m| am)\s+(?:a |an )?(.+?)(?:\.|,|;|!|\n|$)"),
    ("fact", r"\b(?:that (?:makes|brings)|now have|I have|total of|I've tried)\s+(\d+)\s+(.+?)(?:\.|,|;|!|\n|$)"),
    ("event", r"\bI\s+(?:went|visited|attended|tried|started|finished|completed)\s+(?:a |an |the |my |to )?(.+?)(?:\.|,|;|!|\n|$)"),
    ("decision", r"\bI\s+(?:decided|chose|picked|selected|went with)\s+(?:a |an |the |to )?(.+?)(?:\.|,|;|!|\n|$)"),
    ("fact", r"\bmy\s+(\w+(?:\s+\w+)?)\s+is\s+(.+?)(?:\.|,|;|\n|$)"),
    ("decision", r"\bI\s+(?:switched|changed|moved|upgraded)\s+(?:from\s+\w+\s+)?to\s+(?:a |an |the )?(.+?)(?:\.|,|;|!|\n|$)"),
    ("fact", r"\bI(?:'ve| have)\s+been\s+(.+?)(?:\.|,|;|!|\n|$)"),
    ("event", r"[Uu]ser\s+(?:tried|visited|attended|went to|started)\s+(?:a |an |the )?(.+?)(?:\.|,|;|!|\n|$)"),
    ("preference", r"[Uu]ser\s+(?:uses?|owns?|has|bought|prefers?|likes?|enjoys?)\s+(?:a |an |the )?(.+?)(?:\.|,|;|!|\n|$)"),
    ("fact", r"[Uu]ser\s+(?:has tried|has visited)\s+(\d+)\s+(.+?)(?:\.|,|;|!|\n|$)"),
    ("decision", r"[Uu]ser\s+(?:switched|changed|moved|upgraded)\s+(?:from\s+\w+\s+)?to\s+(?:a |an |the )?(.+?)(?:\.|,|;|!|\n|$)"),
    ("fact", r"[Uu]ser(?:'s| is)\s+(?:a |an )?(.+?)(?:\.|,|;|!|\n|$)"),
    ("fact", r"[Uu]ser\s+(?:works?|lives?|studies)\s+(?:at|in|for)\s+(.+?)(?:\.|,|;|!|\n|$)"),
]
CARD_ROLES = r"\[(?:user|assistant|Date:[^\]]*)\]:\s*"
CARD_NOISE = ["to", "it", "them", "this", "that", "also", "just", "really", "very", "a new", "the same", "more", "some", "any"]
