"""Weights, tiers and term lists of the ranking engine, as plain values that become literals in a plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Tiers as (least value, factor), highest first.
RATING_TIERS = ((4.8, 1.3), (4.5, 1.2), (4.0, 1.1))
REVIEW_TIERS = ((100, 1.2), (50, 1.15), (20, 1.1))
YEARS_TIERS = ((20, 1.15), (10, 1.1))
VOLUME_TIERS = ((150, 2.5), (100, 2.2), (75, 2.0), (50, 1.7), (30, 1.5), (20, 1.4), (10, 1.3), (5, 1.2), (1, 1.1))
VERIFIED_FACTOR, IRRELEVANT_FACTOR = 1.1, 0.85
# Fixed values: (greatest distance in miles, factor), nearest first.
PROXIMITY_TIERS = ((1, 1.6), (2, 1.5), (3, 1.4), (5, 1.3), (8, 1.2), (12, 1.1), (18, 1.05))
# Words that say nothing about what is sought.
GENERIC_TERMS = tuple(
    """surgical treatment procedure surgery operation consultation assessment examination diagnostic therapy care management
    service clinic hospital patient medical clinical health doctor specialist practitioner london want need help find looking
    require being referred person visit appointment see""".split()
)
# How often each part of a profile counts in the production ranker's text.
PRODUCTION_FIELDS = {
    "procedures": 3, "conditions": 3, "clinical_interests": 2, "expertise": 3, "procedure_groups": 3, "specialty": 3, "specialty_description": 2, "description": 2,
    "about": 1, "name": 1, "address_locality": 1, "memberships": 1, "insurers": 1, "title": 1,
}

# Places that an address may name; those within London; postcode areas of London.
CITIES = tuple(
    """london,manchester,birmingham,leeds,glasgow,liverpool,edinburgh,bristol,sheffield,cardiff,nottingham,newcastle,leicester,coventry,
    belfast,reading,brighton,cambridge,oxford,southampton,york,exeter,bath,norwich,derby,aberdeen,dundee,portsmouth,plymouth,wolverhampton,
    stoke-on-trent,sunderland,guildford,cheltenham,colchester,windsor,chester,canterbury,salisbury,winchester,st albans,swansea,newport,
    middlesbrough,bolton,stockport,luton,slough,watford,woking,crawley,maidstone,ipswich,peterborough,milton keynes,northampton,swindon,
    gloucester,worcester,hereford,lincoln,carlisle,durham,wakefield,huddersfield,halifax,blackpool,preston,burnley,warrington,wigan,rochdale,
    oldham,doncaster,rotherham,barnsley,scunthorpe,grimsby,hull,harrogate,scarborough,chelmsford,basildon,southend-on-sea,romford,ilford,
    enfield,barnet,croydon,bromley,kingston upon thames,richmond,wimbledon,putney,marylebone,mayfair,st johns wood,hampstead,highgate,
    elstree,bushey,stanmore,edgware,surrey,essex,kent,sussex,hertfordshire,berkshire,buckinghamshire,hampshire,suffolk,norfolk,devon,
    cornwall,dorset,somerset,wiltshire,oxfordshire,warwickshire,staffordshire,cheshire,lancashire,yorkshire""".replace("\n    ", "").split(",")
)
LONDON_BOROUGHS = tuple(
    """westminster,chelsea,kensington,hammersmith,fulham,camden,islington,hackney,tower hamlets,greenwich,lambeth,southwark,wandsworth,
    lewisham,bromley,croydon,barnet,enfield,harrow,ealing,hounslow,richmond,kingston,merton,sutton,bexley,havering,redbridge,
    waltham forest,newham,barking,dagenham,hillingdon,haringey,city of london,marylebone,mayfair,soho,fitzrovia,bloomsbury,st johns wood,
    hampstead,highgate,finchley,wimbledon,putney,battersea,clapham,brixton,dulwich,peckham,deptford,woolwich,eltham,stratford,bow,poplar,
    canary wharf,docklands""".replace("\n    ", "").split(",")
)
LONDON_AREAS = ("E", "EC", "N", "NW", "SE", "SW", "W", "WC")
# Phrases that a specialty adds to a query's anchors.
SPECIALTY_ANCHORS = {
    "physiotherapy": ("physiotherapy", "pelvic pain", "pelvic floor"),
    "physiotherapist": ("physiotherapy", "pelvic pain", "pelvic floor"),
    "dietitian": ("dietitian", "nutrition", "dietetics"),
}
# What a query that names a specialty says (in lower case).
SPECIALTY_PATTERNS = {
    "Physiotherapy": (r"\bphysiotherapist\b", r"\bphysiotherapy\b", r"\bpelvic\s*physio\b", r"\bphysio\b.*pelvic", r"pelvic\s+pain\s+physio"),
    "Dietitian": (r"\bdietitian\b", r"\bdietetics\b", r"\bnutrition\s*specialist\b"),
}
# Patterns of symptoms and conditions that may enter a query, and of procedures that may not.
SAFE_PATTERNS = ("chest pain", "angina", r"coronary(?!\s+(angiography|intervention|stent|bypass))", "ischaemic", "heart disease", "palpitation", "arrhythmia", "breathless", "dyspnea")
UNSAFE_PATTERNS = ("interventional", "angiography", "pci", "stent", "surgery", "procedure", "bypass", "catheter")
# Short names of specialties.
SLUGS = {"cardiology": "cardio", "general surgery": "general", "obstetrics and gynaecology": "obsgynae", "ophthalmology": "ophthal", "trauma & orthopaedic surgery": "ortho"}
# How patients name a place (in this order), and what is cut from what they say (one after another).
_NAME = r"([A-Z][a-z]+(?:\s+[a-z]+)?(?:\s+[A-Z][a-z]+){0,2})"
PLACE_PATTERNS = (
    rf"(?i)based\s+in\s+{_NAME}(?:\s|\z|,|\.|and)",
    rf"(?i)\bin\s+{_NAME}(?:\s|\z|,|\.|and)",
    rf"(?i)location[:\s]+{_NAME}(?:\s|\z|,|\.)",
    rf"(?i)near\s+{_NAME}(?:\s|\z|,|\(|\.)",
    rf"(?i)from\s+{_NAME}(?:\s|\z|,|\.)",
    rf"(?i)(?:within\s+)?(?:\d+\s+)?(?:hour|miles?|km)?\s+from\s+{_NAME}(?:\s|\z|,|\.)",
    rf"(?m)(?:^|,\s*){_NAME}(?:\s|$|,|\.)",
)
_TRAILING = r"(?i)\s+(and|or|but|no|don|do|have|has|does|did|can|could|would|will|should|not|doesn|didn|won|can't|couldn|wouldn|terms|but)"
PLACE_CLEANING = (
    (r"\s*\([^)]+\)\z", ""), (r"(?i)^(the|a|an)\s+", ""), (rf"{_TRAILING}\s*\z", ""), (rf"{_TRAILING}\s+.*\z", ""), (r"\s*\n\s*", " "), (r"\s+", " "), (r"(?i)\s+(No|Yes|Not)\z", ""),
    (r"(?i)^(in|at|on|for|with|from|to|the|a|an)\s+", ""),
)
# Places that are known, first names that are not places, and words that no place may hold.
KNOWN_PLACES = tuple(
    """London,Birmingham,Manchester,Liverpool,Leeds,Sheffield,Bristol,Cardiff,Edinburgh,Glasgow,Newcastle,Nottingham,Leicester,Coventry,Belfast,
    Worcester,Oxford,Cambridge,Brighton,Southampton,Portsmouth,Norwich,Wales,Scotland,England,Northern Ireland,Yorkshire,Surrey,Kent,Essex,
    Merseyside,Greater Manchester,West Midlands,East Midlands,South West,South East,Swansea,Bath,York,Canterbury,Durham,Exeter,Plymouth,Reading,
    Milton Keynes,Bridgend,Surbiton,High Wycombe,Kingston Upon Thames,Kingston,Midlands,South Wales,North Wales,West London,East London,
    North London,South London""".replace("\n    ", "").split(",")
)
FIRST_NAMES = ("Laura", "Emily", "Jess", "Caitlin", "Michelle", "Raph", "Abbie", "Sarah", "Estelle", "Bethany")
NO_PLACES = tuple(
    """Patient She He They Within About Around Travel Hospital Centre Center Clinic Surgery Therapy Treatment Management Understanding Whether
    Related Pelvic Floor Tension Nerve Sensitisation Muscular Imbalance Factors Goal Learn Manage Reduce Flare Exercise Safely Without
    Exacerbating Symptoms Improve Overall Quality Life Avoiding Further Seeking Specific Experience Post Surgical Pain Physiotherapist
    Specialist Doctor Consultant Endometriosis Adenomyosis Gastroenterology Gynaecology Cardiology Great Thank Thanks Hello Hi Hey Please
    Help Looking Find Someone Insurance Have Don Does Can Could Would""".split()
)
# What counts for a pelvic-pain physiotherapist, besides: specialties with their points, and words of a personal statement.
PELVIC_SPECIALTIES = (("urogynaecology", 12), ("musculo skeletal", 8), ("sexual dysfunction", 5), ("sports", 5))
PELVIC_WORDS = (
    "endometriosis", "pelvic pain", "chronic pain", "post-surgical", "surgery", "flare", "exercise", "pelvic floor", "nerve",
    "muscular", "tension", "pain management", "rehabilitation", "urogynaecology", "women",
)


@dataclass(frozen=True)
class RankingConfig:
    """One ranking set-up; ``variant`` picks the idf formula and whether repeated query words count."""

    k1: float = 1.5
    b: float = 0.75
    variant: str = "production"
    top_n: int = 150
    top_k: int = 12
    semantic_weight: float = 0.3
    intent_weight: float = 0.3
    anchor_weight: float = 0.5
    subspecialty_weight: float = 0.3
    subspecialty_cap: float = 0.5
    safe_terms: int = 4
    fields: dict = field(default_factory=lambda: dict(PRODUCTION_FIELDS), hash=False)

    def merged(self, **changes) -> "RankingConfig":
        """A copy with the given values; None leaves a value as it is."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    def stage_a_size(self) -> int:
        return max(self.top_n, 10 * self.top_k, 50)
