"""Fixed values that results depend on, and settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Skill aliases and the default skill vocabulary.
SKILL_ALIASES = {"c++": "cpp", "c#": "csharp", "node.js": "nodejs", "ci/cd": "cicd"}
SKILLS = [
    "python", "java", "javascript", "typescript", "cpp", "csharp", "ruby", "go", "rust", "php", "sql", "nosql",
    "mysql", "postgresql", "mongodb", "redis", "elasticsearch", "django", "flask", "fastapi", "spring", "react",
    "angular", "vue", "nodejs", "express", "docker", "kubernetes", "aws", "azure", "gcp", "terraform", "ansible",
    "git", "cicd", "jenkins", "gitlab", "github actions", "nlp", "machine learning", "deep learning", "computer vision",
    "tensorflow", "pytorch", "agile", "scrum", "jira", "api", "rest", "graphql", "microservices", "html", "css",
    "sass", "webpack", "babel", "linux", "bash", "shell scripting", "nginx", "apache",
]

# Canonical spellings of skills and organisations.
SKILL_NAMES = {"python3": "python", "python 3": "python", "js": "javascript", "ts": "typescript", "c++": "cpp", "c#": "csharp", "node.js": "nodejs", "node js": "nodejs"}
ORG_NAMES = {"amazon web services": "amazon", "aws": "amazon", "google cloud": "google", "gcp": "google", "microsoft azure": "microsoft", "azure": "microsoft", "meta": "facebook", "meta platforms": "facebook"}

# Words that open a section, anywhere in a text.
SECTION_WORDS = {
    "experience": "work experience|experience|employment history",
    "education": "education|academic background|qualifications",
    "skills": "skills|technical skills|core competencies|technologies",
    "projects": "projects|personal projects|key projects|portfolio",
    "summary": "summary|profile|objective|about me",
}

# Keywords of education tiers, highest first, and words that a role must hold.
EDUCATION_TIERS = {
    4: ["phd", "ph.d", "doctorate", "doctor of"],
    3: ["master", "m.tech", "m.sc", "mba", "m.e", "ms ", "m.s"],
    2: ["bachelor", "b.tech", "b.e", "b.sc", "b.com", "be ", "btech", "undergraduate", "b.a", "b.s"],
    1: ["diploma", "certificate", "associate"],
}
TITLE_ENDS = ["engineer", "developer", "manager", "analyst", "architect", "scientist", "specialist"]
ROLE_WORDS = ["engineer", "developer", "analyst", "manager", "architect", "scientist", "specialist", "consultant", "lead", "director"]

# Job titles, months, stages in their order, and terms that an answer must not bring up by itself.
JOB_TITLES = r"software engineer|backend engineer|frontend engineer|full[\s-]?stack|data scientist|ml engineer|devops|product manager|tech lead|engineering manager|senior|junior|intern|associate"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WATCHED_TERMS = ["aws", "kubernetes", "docker", "python", "java", "react", "node.js"]


@dataclass(frozen=True)
class RankingConfig:
    """Weights of the four scores and the limits below which a candidate's final score is zero."""

    weights: dict = field(default_factory=lambda: {"semantic": 0.45, "skill_match": 0.30, "experience": 0.15, "education": 0.10})
    min_skill_overlap: float = 0.0
    min_experience_years: float = 0.0

    def merged(self, override: dict | None) -> RankingConfig:
        """An override replaces single weights and limits; anything else in it is ignored. Sums aren't checked."""
        o = override or {}
        limits = {k: v for k, v in o.get("hard_filters", {}).items() if k in ("min_skill_overlap", "min_experience_years")}
        return RankingConfig({**self.weights, **o.get("weights", {})}, **{"min_skill_overlap": self.min_skill_overlap, "min_experience_years": self.min_experience_years, **limits})


def checked_weights(weights: dict) -> dict:
    """The weights of a re-ranking: all four, summing to 1 within a hundredth."""
    if set(weights) != {"semantic", "skill_match", "experience", "education"}:
        raise ValueError("weights need semantic, skill_match, experience and education")
    if not 0.99 <= sum(weights.values()) <= 1.01:
        raise ValueError("weights must sum to 1")
    return weights

def checked_request(description: str | None = None, top_k: int | None = None, limit: int | None = None, most: int = 500, offset: int = 0, score: float | None = None, position: int | None = None) -> dict:
    """The parameters of a request, the description stripped, or an error that names the first that is out of bounds."""
    if description is not None and not description.strip():
        raise ValueError("the description must be non-empty")
    for name, value, low, high in (("top_k", top_k, 1, None), ("limit", limit, 1, most), ("offset", offset, 0, None), ("score", score, 0, 1), ("position", position, 1, None)):
        if value is not None and (value < low or (high is not None and value > high)):
            raise ValueError(f"{name} must be {low} or more" if high is None else f"{name} must be {low} to {high}")
    return {"description": description and description.strip(), "top_k": top_k, "limit": limit, "offset": offset, "score": score, "position": position}


# Where the reports of a collection are.
REPORT_PATHS = {
    "validation": "reports/validation_report.json",
    "duplicates": "reports/duplicate_report.json",
    "ranking_summary": "reports/ranking_summary.json",
    "latency": "reports/latency_report.json",
    "latency_rag": "reports/latency_report_rag.json",
    "latency_rank": "reports/latency_report_rank.json",
    "ranking_json": "outputs/ranking_results.json",
    "ranking_csv": "outputs/ranking_results.csv",
    "meta": "collection_meta.json",
}

# A candidate's block in a prompt, and what stands around the blocks.
PROMPT_BLOCK = "Candidate %d:\n- Filename: %s\n- Rank: %s\n- Score: %s\n- Skills: %s\n- Excerpt: %s"
PROMPT_PARTS = ("Candidates:\n", "\n\nQuestion: ", "\nAnswer based on the candidates above:")

# What the lines that open a section begin with.
SECTION_LINES = {
    "summary": r"summary|profile|objective|about|overview|executive\s+summary|professional\s+summary|career\s+summary",
    "experience": r"experience|work\s+experience|employment|professional\s+experience|work\s+history|career\s+history|professional\s+background",
    "skills": r"skills|technical\s+skills|core\s+skills|competencies|expertise|key\s+skills|skill\s+set|technologies|tools\s+and\s+technologies",
    "education": r"education|academic\s+background|qualifications|academic\s+qualifications|degrees|academics",
    "projects": r"projects|key\s+projects|notable\s+projects|project\s+experience|selected\s+projects|project\s+portfolio",
}

# Patterns of degrees, fields of study and roles. Spellings that differ in case only are one.
DEGREES = [
    r"B\.?\s*Tech|B\.?\s*E|Bachelor\s+of\s+Technology|Bachelor\s+of\s+Engineering",
    r"M\.?\s*Tech|M\.?\s*E|Master\s+of\s+Technology|Master\s+of\s+Engineering",
    r"B\.?\s*S\.?\s*C|Bachelor\s+of\s+Science",
    r"M\.?\s*S\.?\s*C|Master\s+of\s+Science",
    r"B\.?\s*A|Bachelor\s+of\s+Arts",
    r"M\.?\s*A|Master\s+of\s+Arts",
    r"PhD|Ph\.?\s*D|Doctorate|Doctor\s+of\s+Philosophy",
    r"MBA|Master\s+of\s+Business\s+Administration",
    r"BBA|Bachelor\s+of\s+Business\s+Administration",
]
STUDY_FIELDS = [
    r"Computer\s+Science|CS|C\.?\s*S",
    r"Software\s+Engineering|SE",
    r"Information\s+Technology|IT",
    r"Electrical\s+Engineering|EE|E\.?\s*E",
    r"Mechanical\s+Engineering|ME|M\.?\s*E",
    r"Data\s+Science|DS",
    r"Artificial\s+Intelligence|AI",
    r"Machine\s+Learning|ML",
]
ROLE_PATTERNS = [
    r"(?:Senior|Junior|Lead|Principal|Staff|Associate)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*",
    r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Engineer|Developer|Architect|Manager|Analyst|Scientist|Specialist)",
    r"(?:Software|Backend|Frontend|Full\s+Stack|DevOps|Data|ML|AI)\s+(?:Engineer|Developer|Architect)",
]

# Words that show a context, with its weight; the weight without any; weights of sections in a score.
CONTEXTS = {
    "experience": (["experience", "worked", "job", "position"], 0.5),
    "projects": (["project", "built", "developed", "implemented"], 0.2),
    "skills": (["skill", "technology", "tool", "proficient"], 0.3),
}
NO_CONTEXT = 0.1
SECTION_WEIGHTS = {"experience": 0.5, "skills": 0.3, "projects": 0.2}

# Month names, and a range of dates.
_MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december"
DATE_RANGE = rf"(?i)({_MONTH})?\s*(\d{{4}})\s*[-–—to]+\s*(present|current|now|(?:{_MONTH})?\s*\d{{4}})"

# The order of stages in a latency report.
STAGES = ["text_extraction", "ocr", "parsing", "chunking", "embedding_generation", "ner", "llm", "db_writes"]

#: English words that n-grams leave out where no longer list is installed.
_COMMON_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being",
    "below", "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had",
    "has", "have", "having", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "may", "me", "might", "more",
    "most", "must", "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "she", "should",
    "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until",
    "up", "us", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your",
]


def english_stop_words() -> list[str]:
    """The list "english" of scikit-learn, which the vectorisers' results rest on, where that library is installed; else a
    shorter one of our own. Any other list can be given to `functions.text.terms`."""
    try:
        from sklearn.feature_extraction.text import ENGLISH_STOP_WORDS
    except ImportError:
        return _COMMON_WORDS
    return sorted(ENGLISH_STOP_WORDS)


STOP_WORDS = english_stop_words()

# Files that are taken, and names that are junk.
SUFFIXES = ("pdf", "docx", "txt")
JUNK = r"(^|/)(\._[^/]*|\.DS_Store|Thumbs\.db|~\$[^/]*)$"
