"""Word lists and patterns that the operators take as parameters. All of them are fixed values: results are to equal published ones."""

from __future__ import annotations

from dataclasses import dataclass, field

# Patterns of the labels, matched on text in lower case.
IDENTITY = {
    "panethnic": r"\b(hispanic(?:s)?|latino(?:s|a|as)?|spanish[- ]speaking|spanish[- ]surname)\b",
    "ethnic": r"\b(chicano(?:s|a|as)?|mexican[- ]american(?:s)?|puerto rican(?:s)?|cuban[- ]american(?:s)?|dominican(?:s)?|salvadoran(?:s)?|guatemalan(?:s)?|nicaraguan(?:s)?)\b",
}
FRAMES = {
    "policy_frame_data": r"\b(data|dataset|statistics?|statistical|census|survey|surveys|percent(?:age)?s?|rate(?:s)?|estimate(?:s)?|count(?:s|ed|ing)?|undercount|report(?:ed|s)?|evidence|numbers?)\b",
    "policy_frame_funding": r"\b(fund(?:s|ed|ing)?|funding|grant(?:s)?|appropriation(?:s)?|budget(?:s)?|allocat(?:e|ed|ion|ions)|federal dollars?|subsid(?:y|ies)|revenue(?:s)?|financ(?:e|ed|ing)|endow(?:ed|ment)?)\b",
}
DOMAINS = {
    "domain_education": r"\b(education|school(?:s)?|student(?:s)?|teacher(?:s)?|classroom|curriculum|bilingual education|head start|college|university|dropout)\b",
    "domain_employment_labor": r"\b(employ(?:ment|ed|er|ers)?|labor|worker(?:s)?|wage(?:s)?|unemployment|job(?:s)?|farm ?worker(?:s)?|union(?:s)?)\b",
    "domain_health": r"\b(health|healthcare|medical|medicaid|medicare|clinic(?:s)?|hospital(?:s)?|mental health|public health|nutrition)\b",
    "domain_housing": r"\b(housing|rent(?:al)?|tenant(?:s)?|mortgage(?:s)?|home(?:s|ownership)?|homeless(?:ness)?)\b",
    "domain_immigration": r"\b(immigration|immigrant(?:s)?|migrant(?:s)?|border|deport(?:ation|ed)?|undocumented|refugee(?:s)?|visa(?:s)?)\b",
    "domain_civil_rights_voting": r"\b(civil rights?|vot(?:e|ing|er|ers)|elect(?:ion|oral)?|redistrict(?:ing)?|representation|political participation)\b",
    "domain_anti_discrimination_equal_opportunity": r"\b(anti[- ]discriminat(?:ion|ory)|discriminat(?:ion|e|ed|ory)|equal opportunity|equal employment opportunity|affirmative action|equal access|fair treatment|racial equality|nondiscriminat(?:ion|ory)|eeoc)\b",
    "domain_social_policy": r"\b(social policy|social services?|public assistance|welfare|poverty|poor\b|low[- ]income|income inequality|economic inequality|inequalit(?:y|ies)|inequit(?:y|ies)|opportunity gap|social mobility|safety net|food stamps?|family services?|child care)\b",
    "domain_criminal_justice": r"\b(police|policing|prison(?:s)?|jail(?:s)?|incarcerat(?:ion|ed)|crime|criminal justice|court(?:s)?|sentenc(?:e|ing))\b",
    "domain_business_development": r"\b(small business(?:es)?|business development|entrepreneur(?:s|ship)?|mesbic|loan(?:s)?|investment|contract(?:s|ing)?|procurement)\b",
}
THEME = {
    "theme_invisibility": r"\b(invisible|invisibility|ignored|overlooked|unseen|forgotten|voiceless|silenced|marginali[sz]ed|excluded|left out|underrepresented|hidden population(?:s)?|undercount(?:ed|ing)?|undercount(?:s)?|not counted|not count(?:ed)?|not captured|uncaptured|miscount(?:ed|ing)?|statistically invisible|ignored by (?:the )?(?:data|statistics)|missing from (?:the )?(?:data|statistics)|not reflected in (?:the )?(?:data|statistics)|not in (?:the )?census)\b",
}
ALL_PATTERNS = IDENTITY | FRAMES | DOMAINS | THEME
COMBINED = "domain_anti_discrimination_equal_opportunity"
#: The themes that groups are compared by: the combined one is split in two, and counting words are no theme.
THEMES = sorted([*(d for d in DOMAINS if d != COMBINED), "policy_frame_funding", "theme_invisibility", "theme_anti_discrimination", "theme_equal_opportunity"])

# Words that are no terms. Words of fewer than four letters are no terms in any case and so aren't listed; names of a
# corpus's own publisher are for the caller to add.
STOPWORDS = """
    about above after again against because been before being below between both could does doing down during each from further have
    having here hers herself himself into itself just more most myself once only other ours ourselves over same should some such than that
    their theirs them themselves then there these they this those through under until very were what when where which while whom will
    with your yours yourself yourselves agenda council issue volume number page pages newsletter washington also three first
    second third fourth year years time state states united national american americans said says would must many much among however
    including within across based used using well make made still since every another week month months government office program
    programs group groups work works worked working people person percent january february march april june july august september
    october november december throughout country city york
""".split()
# The usual English function words that texts are rid of before vectors are made from them.
FUNCTION_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into through during before after above below to
    from up down in out on off over under again further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn
    haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# Fixed values.
IDENTITY_TERMS = """
    hispanic hispanics latino latinos latina latinas spanish speaking surname chicano chicanos mexican mexicans puerto rican ricans
    cuban dominican salvadoran guatemalan nicaraguan
""".split()
NOISE_TOKENS = "tion ment com con ity ities ence ences ings ing pro".split()
# Fixed values.
POLICY_TERMS = """
    civil rights voting legal defense affirmative equal employment discrimination education bilingual school schools student students
    teacher teachers curriculum health care mental welfare labor workers worker farm housing rent tenant immigration immigrant border
    deportation undocumented refugee visa social economic development poverty services public federal department business minority
    opportunity justice criminal police prison jail court policy funding budget grant
""".split()
# Fixed values.
ALIASES = {"broadcasting": "broadcast", "departments": "department", "workers": "worker", "schools": "school", "services": "service", "agencies": "agency"}
MODIFIERS = "urban mental social economic public civil equal minority federal legal criminal affirmative bilingual high small".split()
HEADS = "department housing health education employment service policy right worker labor development business opportunity court force market center welfare commerce statistic".split()
# Fixed values.
LABELS = {
    "administration business": "business administration",
    "business enterprise": "business enterprise",
    "care health": "health care",
    "department labor": "labor department",
    "department justice": "justice department",
    "economic social": "social economic",
    "housing urban": "urban housing",
    "equal opportunity": "equal opportunity",
}
CANONICAL = {"health education": "health education welfare", "education welfare": "health education welfare"}
# Fixed values.
MONTHS = {
    "JAN": 1, "JANUARY": 1, "FEB": 2, "FEBRUARY": 2, "MAR": 3, "MARCH": 3, "APR": 4, "APRIL": 4, "MAY": 5, "JUN": 6, "JUNE": 6, "JUL": 7, "JULY": 7, "AUG": 8,
    "AUGUST": 8, "SEP": 9, "SEPT": 9, "SEPTEMBER": 9, "OCT": 10, "OCTOBER": 10, "NOV": 11, "NOVEMBER": 11, "DEC": 12, "DECEMBER": 12,
}
QUARTERS = {"FIRST": 3, "SECOND": 6, "THIRD": 9, "FOURTH": 12}


@dataclass
class TermLexicon:
    """Which words are terms and how they are named."""

    stopwords: list[str] = field(default_factory=lambda: STOPWORDS)
    identity: list[str] = field(default_factory=lambda: IDENTITY_TERMS)
    noise: list[str] = field(default_factory=lambda: NOISE_TOKENS)
    policy: list[str] = field(default_factory=lambda: POLICY_TERMS)
    aliases: dict[str, str] = field(default_factory=lambda: ALIASES)
    modifiers: list[str] = field(default_factory=lambda: MODIFIERS)
    heads: list[str] = field(default_factory=lambda: HEADS)
    labels: dict[str, str] = field(default_factory=lambda: LABELS)
    canonical: dict[str, str] = field(default_factory=lambda: CANONICAL)
