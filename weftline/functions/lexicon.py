"""Fixed values of the dialogue: words and patterns that decide what a message says. They are stated as they have to be, and hold no logic."""

from __future__ import annotations

#: Words of requests and the category each stands for.
CATEGORY_OF = {
    "jacket": "jacket", "jackets": "jacket", "coat": "coat", "coats": "coat", "parka": "coat", "blazer": "blazer", "suit": "suit", "vest": "vest",
    "shirt": "shirt", "shirts": "shirt", "tshirt": "shirt", "tee": "shirt", "blouse": "blouse", "top": "top", "tank": "tank top",
    "sweater": "sweater", "sweaters": "sweater", "pullover": "sweater", "cardigan": "cardigan", "hoodie": "hoodie", "hoodies": "hoodie",
    "sweatshirt": "sweatshirt", "dress": "dress", "dresses": "dress", "gown": "dress", "skirt": "skirt", "pants": "pants", "trousers": "pants",
    "chinos": "pants", "jeans": "jeans", "shorts": "shorts", "leggings": "leggings", "tights": "tights", "joggers": "joggers",
    "sweatpants": "sweatpants", "shoe": "shoes", "shoes": "shoes", "sneaker": "sneakers", "sneakers": "sneakers", "trainers": "sneakers",
    "boot": "boots", "boots": "boots", "sandal": "sandals", "sandals": "sandals", "heel": "heels", "heels": "heels", "loafers": "loafers",
    "flats": "flats", "slippers": "slippers", "sock": "socks", "socks": "socks", "hat": "hat", "hats": "hat", "cap": "cap", "beanie": "beanie",
    "glove": "gloves", "gloves": "gloves", "mittens": "gloves", "scarf": "scarf", "scarves": "scarf", "belt": "belt", "belts": "belt",
    "tie": "tie", "ties": "tie", "watch": "watch", "watches": "watch", "ring": "ring", "rings": "ring", "necklace": "necklace",
    "necklaces": "necklace", "pendant": "necklace", "bracelet": "bracelet", "bracelets": "bracelet", "earring": "earrings",
    "earrings": "earrings", "bag": "bag", "bags": "bag", "backpack": "backpack", "purse": "purse", "handbag": "handbag", "tote": "tote",
    "wallet": "wallet", "wallets": "wallet", "bra": "bra", "bras": "bra", "underwear": "underwear", "swimsuit": "swimsuit", "bikini": "bikini",
    "trunks": "swim trunks", "pajamas": "pajamas", "robe": "robe",
}

#: Slots, and whether they hold one value or several.
SINGLE = {"category": True, "size": True, "brand": True, "budget": True, "color": False, "material": False}

#: Patterns that announce a replacement or an addition.
REPLACE_CUE = (
    r"\b(?:actually|instead|rather|scratch that|forget (?:the|that|my|about)|changed? my mind|second thought|no,? wait|wait,? no|"
    r"make it|change (?:it |that |this )?to|switch to|swap|replace)\b")
ADD_CUE = r"\b(?:also|plus|as well|in addition|additionally|and also|along with)\b"

#: Fixed value: what a cue that follows a value counts as farther away.
FOLLOWING = 50

#: Words that take a value away, within three words before it, or next to it.
STRONG_NEGATIONS = ("without", "remove", "lose", "skip", "minus", "nix", "exclude", "ditch")
NEXT_NEGATIONS = ("not", "no")
REFUSALS, WISHES = ("don't", "dont"), ("want", "need")
REACH = 3

#: Words that mark a slot in a message.
MARKER_WORDS = (
    "size", "budget", "brand", "color", "colour", "material", "priced", "price", "cost", "costs", "dollars", "usd", "bucks", "under", "around",
    "about", "approximately", "roughly", "over", "above", "below")

#: Words that messages of correction are made of.
CORRECTION_WORDS = (
    "actually", "instead", "rather", "ignore", "forget", "earlier", "previous", "prior", "preference", "preferences", "mind", "wait", "scratch",
    "nevermind", "disregard", "what", "need", "needed")

#: Words about shopping itself.
FRAMING_WORDS = (
    "still", "exploring", "explore", "browsing", "browse", "shopping", "considering", "consider", "undecided", "deciding", "key", "requirement",
    "requirements", "criteria", "matters", "matter", "important", "priority", "prioritize", "essential", "recommend", "recommendation",
    "recommendations", "suggest", "suggestion", "suggestions", "options", "option", "something", "anything", "everything", "help")

#: Words of requirement and of hesitation, negations that turn a requirement round, and the confidence each kind of message has.
REQUIREMENT_WORDS = (
    "requirement", "requirements", "required", "require", "must", "need", "needs", "needed", "specifically", "exactly", "matter", "matters",
    "important", "essential", "critical", "necessary")
HEDGES = (
    "maybe", "perhaps", "possibly", "probably", "might", "guess", "something", "anything", "some", "kind", "sort", "ish", "like", "prefer",
    "preferably", "ideally", "leaning", "considering", "thinking", "exploring", "browsing", "unsure", "open", "whatever", "either")
NEGATIONS = (
    "not", "no", "never", "cannot", "cant", "nope", "isn", "aren", "wasn", "weren", "doesn", "don", "didn", "won", "wouldn", "shouldn", "couldn")
REQUIRED, CORRECTED, STATED, HEDGED = 1.0, 0.9, 0.7, 0.4

#: Fixed values of the mode: slots that are specific, words of requirement and of browsing, soft qualities and occasions, and filler.
SPECIFIC_SLOTS = ("color", "material", "brand", "size", "budget")
MODE_REQUIREMENTS = (
    "requirement", "requirements", "required", "must", "need", "needs", "needed", "specifically", "exactly", "matters", "important", "essential")
MODE_BROWSING = (
    "exploring", "explore", "browsing", "browse", "ideas", "idea", "suggestions", "suggest", "options", "recommend", "recommendations",
    "inspiration", "unsure", "maybe", "anything", "something")
MODE_SOFT = (
    "comfortable", "comfy", "cozy", "soft", "nice", "good", "great", "better", "best", "casual", "everyday", "versatile", "simple", "basic",
    "classic", "stylish", "cute", "cool", "warm", "light", "lightweight", "durable", "quality", "affordable", "cheap", "expensive", "travel",
    "traveling", "travelling", "trip", "vacation", "holiday", "work", "office", "school", "gym", "workout", "hiking", "walking", "weekend",
    "daily", "party", "wedding", "summer", "winter", "spring", "fall", "autumn", "outdoor", "indoor", "gift", "present")
MODE_FILLER = (
    "still", "just", "really", "quite", "very", "kind", "sort", "bit", "little", "more", "less", "much", "thing", "things", "one", "ones",
    "prefer", "like", "love", "help", "find", "show", "give", "get")

#: Attributes that may be asked about, the open question, those a catalogue column can judge and those only words can.
ASKABLE = ("category", "material", "color", "size", "style", "brand", "budget", "feature", "use_case", "other")
OPEN_QUESTION = "other"
JUDGED = ("color", "material", "size", "budget")
UNJUDGED = ("feature", "use_case", "style")

#: Least value of a question, open questions of a session, candidates a question is judged on, and turns of a session.
ASK_FLOOR, OPEN_QUESTIONS, ASK_DEPTH, TURNS = 0.10, 1, 50, 10
