"""Vocabularies, sentences and thresholds of the curated question/answer data.

Fixed values: results must equal these texts and numbers, so they stand here
plainly and in their natural order.
"""

from __future__ import annotations

WINDOW_S, STEP_S = 30.0, 15.0
MIN_OVERLAP = 0.5
UNKNOWN_COMMERCIAL = "unknown instrument"
OUTSIDE_TASK = "Other"

# Tools in canonical order.
TOOLS = [
    "needle driver",
    "monopolar curved scissors",
    "force bipolar",
    "clip applier",
    "cadiere forceps",
    "bipolar forceps",
    "vessel sealer",
    "permanent cautery hook/spatula",
    "prograsp forceps",
    "stapler",
    "grasping retractor",
    "tip-up fenestrated grasper",
]
FORCEPS = ["cadiere forceps", "bipolar forceps", "prograsp forceps"]
PRESENCE_TARGETS = [*TOOLS, "forceps"]

# Commercial names of a generic tool.
VARIANTS = {
    "needle driver": ["large suturecut needle driver", "large needle driver", "mega needle driver", "mega suturecut needle driver"],
    "clip applier": ["large clip applier", "small clip applier"],
    "bipolar forceps": ["maryland bipolar forceps", "fenestrated bipolar forceps"],
    "stapler": ["sureform stapler 60", "stapler 45", "sureform stapler 45", "stapler 30 curved-tip", "stapler 45 curved-tip"],
}

# Purposes.
PURPOSE = {
    "needle driver": "to hold and drive needles during suturing",
    "monopolar curved scissors": "to cut and dissect tissue using electrical energy",
    "force bipolar": "to grasp tissue and provide hemostasis using bipolar energy",
    "clip applier": "to apply clips for ligation of vessels or ducts",
    "cadiere forceps": "to grasp and hold tissues or objects during the surgery",
    "bipolar forceps": "to grasp tissue and coagulate using bipolar energy",
    "vessel sealer": "to seal and divide blood vessels",
    "permanent cautery hook/spatula": "to dissect and cauterize tissue",
    "prograsp forceps": "to grasp and retract tissues or objects",
    "stapler": "to staple and divide tissue",
    "grasping retractor": "to retract and expose the surgical field",
    "tip-up fenestrated grasper": "to grasp tissue with a fenestrated jaw for better grip",
}

# Organ of a task (tasks without one are not listed).
TASK_ORGAN = {
    "Uterine horn": "uterine horn",
    "Rectal artery/vein": "rectal artery and vein",
    "Suspensory ligaments": "suspensory ligaments",
    "Skills application": "gallbladder",
}
# Words of a description and the organ they name; the first that occurs decides.
ORGAN_WORDS = [
    ("gallbladder", "gallbladder"),
    ("uterine horn", "uterine horn"),
    ("uterus", "uterus"),
    ("rectal", "rectum"),
    ("artery", "artery"),
    ("vein", "vein"),
    ("ligament", "ligaments"),
    ("peritoneum", "peritoneum"),
    ("colon", "colon"),
    ("bladder", "bladder"),
    ("liver", "liver"),
    ("kidney", "kidney"),
]
DEFAULT_ORGAN = "the tissue in the surgical field"
KNOWN_ORGANS = [
    "uterine horn", "rectal artery and vein", "suspensory ligaments", "gallbladder", "uterus", "peritoneum", "colon", "bladder",
    "liver", "kidney", "rectal", "rectum", "ligament", "artery", "vein",
]
CUTTING_TOOLS = ["monopolar curved scissors", "permanent cautery hook/spatula", "vessel sealer"]
CUTTING_TASKS = ["suspensory ligaments", "uterine horn", "rectal artery/vein", "skills application"]

# Words that route a question.
OPEN_PREFIXES = ["what", "which", "who", "whom", "whose", "where", "when", "how", "why", "name", "list", "describe", "identify"]
PRESENCE_STEMS = ["list", "install", "installation record", "tool record", "use", "present", "involve"]
FORCEPS_VERBS = ["installed", "listed", "mentioned", "used", "recorded", "present"]
PROCEDURE_MARKERS = ["summary describing", "type of surgery", "kind of surgical procedure"]
ORGAN_MARKERS = ["organ is being manipulated", "anatomical structure", "organ is involved", "organ or structure"]
PROCEDURE_ANSWER = "Endoscopic surgery or a laparoscopic surgery"
NO_FORCEPS = "No forceps types are listed."
ORGAN_FALLBACK = "The tissue in the surgical field"

# A marker in the question, and the sentence that frames a bare answer.
FRAMES = [
    ("type of forceps is mentioned", "The type of forceps mentioned is {}."),
    ("forceps type is listed", "The listed forceps type is {}."),
    ("forceps types are listed", "The listed forceps types are {}."),
    ("forceps type is recorded", "The forceps type recorded for this clip is {}."),
    ("forceps type is used", "The forceps type used in this clip is {}."),
    ("type of forceps is present", "The type of forceps present is {}."),
    ("type of forceps is listed", "The type of forceps listed is {}."),
    ("organ is being manipulated", "The organ being manipulated is the {}."),
    ("anatomical structure is being operated on", "The anatomical structure being operated on is the {}."),
    ("organ is involved", "The organ involved in this step is the {}."),
    ("organ or structure does this exercise represent", "The organ this exercise represents is the {}."),
    ("anatomical structure is simulated", "The anatomical structure simulated by this training task is the {}."),
    ("anatomical structure is this training exercise intended to represent", "The anatomical structure this training exercise represents is the {}."),
    ("task is the surgeon performing", "The task the surgeon is performing is {}."),
    ("surgical step is being performed", "The surgical step being performed is {}."),
    ("current surgical task", "The current surgical task is {}."),
]

# Question sentences by type; {} is the subject.
QUESTIONS = {
    "tool_presence": ["Is {} among the tools listed as installed for this clip?", "Does the installation record list {} for this clip?", "Is {} listed in the installed tool record for this clip?"],
    "suture_required": ["Is a suture required in this surgical step?"],
    "task_id": ["What task is the surgeon performing?", "What surgical step is being performed?", "What is the current surgical task?"],
    "organ": ["What organ is being manipulated?", "What anatomical structure is being operated on?", "What organ is involved in this step?"],
    "procedure_type": ["What procedure is this summary describing?", "What type of surgery is being performed?", "What kind of surgical procedure is this?"],
    "tool_purpose": ["What is the purpose of using {} in this procedure?", "What is the general purpose of {}?", "What role is {} intended to serve?"],
    "tissue_cutting": ["Is tissue being cut during this clip?", "Is tissue dissection occurring in this clip?", "Is any cutting happening in this clip?"],
    "description": ["What is the surgeon doing in this step?", "Describe what is happening in this surgical clip.", "What activity is the surgeon performing?"],
    "forceps_none": ["Are any forceps types listed as installed for this clip?"],
    "forceps_one": ["Which forceps type is listed as installed for this clip?"],
    "forceps_many": ["Which forceps types are listed as installed for this clip?"],
}

# The five references of an answer; {} is the subject, {p} a purpose.
ANSWERS = {
    "presence_yes": ["Yes", "Yes, {} is listed as installed.", "Yes, the installation record includes {}.", "Yes, {} appears in the installed tool list.", "The installed tool record lists {}."],
    "presence_no": ["No", "No, {} is not listed as installed.", "No, the installation record does not include {}.", "No, {} does not appear in the installed tool list.", "The installed tool record does not list {}."],
    "forceps_none": ["No forceps types are listed.", "No forceps are listed as installed.", "The installed tool record contains no forceps types.", "There are no forceps types in the installed tool list.", "No installed forceps type is recorded for this clip."],
    "forceps_one": ["{}", "The listed forceps type is {}.", "{} is listed as installed.", "The installed tool record lists {}.", "The forceps type recorded for this clip is {}."],
    "forceps_many": ["{}.", "The listed forceps types are {}.", "{} are listed as installed.", "The installed tool record lists {}.", "The forceps types recorded for this clip are {}."],
    "suture_yes": ["Yes", "Yes, sutures are required.", "Yes, a suture is necessary.", "Yes, the procedure involves sutures.", "Yes, suturing is part of the procedure."],
    "suture_no": ["No", "No, a suture is not required.", "No sutures are necessary.", "No, this step does not involve suturing.", "No, suturing is not part of this step."],
    "task_id": ["{}", "The task is {}.", "{} is being performed.", "The surgeon is performing {}.", "It is {}."],
    "procedure_type": ["Endoscopic surgery or a laparoscopic surgery", "The summary is describing endoscopic or laparoscopic surgery.", "This appears to be endoscopic or laparoscopic surgery.", "The procedure is likely endoscopic or laparoscopic surgery.", "It's endoscopic surgery or laparoscopic surgery based on the summary."],
    "cutting_yes": ["Yes", "Yes, tissue is being cut.", "Yes, the clip shows tissue being cut.", "Yes, cutting of tissue is occurring in this clip.", "Yes, tissue cutting is taking place."],
    "cutting_no": ["No", "No, tissue is not being cut.", "No cutting is visible in this clip.", "No, there is no tissue cutting in this clip.", "No, tissue cutting is not occurring."],
    "organ": ["{C}", "The organ being manipulated is the {}.", "{C} is being manipulated.", "The manipulation involves the {}.", "The organ in focus is the {}."],
    "tool_purpose": ["{P}.", "The purpose of {} is {p}.", "{C} is intended {p}.", "The listed tool, {}, is designed {p}.", "In general, {} serves {p}."],
    "description": ["{D}", "The clip shows that {b}.", "In this step, {b}.", "The surgical activity is: {D}", "This segment shows: {D}"],
}
DESCRIPTION_REJECTS = ["activity outside of the structured training", "training activity is other", "annotator", "annotation note"]

# Question types and their slots for a sampled segment.
TYPE_SLOTS = {"tool_presence": 3, "forceps_type": 1, "suture_required": 1, "task_id": 1, "organ": 1, "procedure_type": 1, "tool_purpose": 1, "tissue_cutting": 1, "description": 1}
DROP_WHEN_BLACK = ["tool_presence", "forceps_type", "tissue_cutting", "organ", "description"]

# Rewriting of organ questions, {} is the label in lower case.
GENERIC_ORGAN = "the tissue in the surgical field"
SEMANTIC_QUESTIONS = [
    "What anatomical structure is this training exercise intended to represent?",
    "Which anatomical structure is simulated by this training task?",
    "What organ or structure does this exercise represent?",
]
SEMANTIC_ANSWERS = [
    "The training exercise represents the {}.",
    "The simulated anatomical structure is the {}.",
    "This training task is intended to model the {}.",
    "The anatomical focus of this exercise is the {}.",
]
BLACK_WEIGHTS = {"procedure_type": 0.1, "suture_required": 0.1, "task_id": 0.2, "tool_purpose": 0.2}
FORBIDDEN = [r"\bforcepss\b", r"\ba forceps\b"]
PRESENCE_CLAIM = r"\b(being used|was used|present|involved|utilized)\b"
