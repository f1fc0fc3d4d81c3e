"""Words, patterns and tables that results depend on."""

from __future__ import annotations

# -- fixed values: legal forms -------------------------------------------------------------
LEGAL_REWRITES_V1 = (
    (r"\bpvt\s+ltd\b", "private limited"), (r"\bpvt\b", "private"), (r"\bltd\b", "limited"),
    (r"\binc\b", "incorporated"), (r"\bcorp\b", "corporation"), (r"\bco\b", "company"),
    (r"\bllc\b", "limited liability"), (r"\bllp\b", "limited liability partnership"),
    (r"\bsarl\b", "sarl"), (r"\bsas\b", "sas"), (r"\bsasu\b", "sasu"), (r"\beurl\b", "eurl"),
    (r"\bsci\b", "sci"), (r"\bgmbh\b", "gmbh"),
)
LEGAL_REWRITES_V3 = (
    (r"\bpvt\s+ltd\b", "private limited"), (r"\bpvt\b", "private"), (r"\bltd\b", "limited"),
    (r"\binc\b", "incorporated"), (r"\bcorp\b", "corporation"), (r"\bco\b", "company"),
    (r"\bllc\b", "limited liability"), (r"\bllp\b", "limited liability partnership"),
    (r"\bsarl\b", "sarl"), (r"\bsas\b", "sas"), (r"\bsasu\b", "sasu"), (r"\beurl\b", "eurl"),
    (r"\bsci\b", "sci"), (r"\bsa\b", "sa"), (r"\bsnc\b", "snc"), (r"\bsca\b", "sca"),
    (r"\bgie\b", "gie"), (r"\bscop\b", "scop"), (r"\bscea\b", "scea"), (r"\bgaec\b", "gaec"),
    (r"\bearl\b", "earl"), (r"\bselarl\b", "selarl"), (r"\bsociete\b", "societe"), (r"\bste\b", "ste"),
    (r"\betablissements\b", "etablissements"), (r"\bets\b", "ets"),
    (r"\bet\s+fils\b", "et fils"), (r"\bet\s+freres\b", "et freres"), (r"\bgmbh\b", "gmbh"),
)
LEGAL_TERMS_V1 = (
    "private limited", "limited liability partnership", "limited liability", "corporation", "incorporated",
    "private", "limited", "company", "sarl", "sas", "sasu", "eurl", "sci",
)
LEGAL_TERMS_V3 = (
    "private limited", "limited liability partnership", "limited liability", "corporation", "incorporated",
    "private", "limited", "company", "sarl", "sas", "sasu", "eurl", "sci", "sa", "snc", "sca", "gie", "scop",
    "scea", "gaec", "earl", "selarl", "societe", "ste", "etablissements", "ets", "et fils", "et freres", "gmbh",
)
LEGAL_DEEP = (
    r"\b(?:inc|incorporated|corp|corporation|co|company|ltd|limited|llc|llp|pvt|private|plc|sa|sas|sarl|srl|gmbh|ag|pty|nv|bv|oy|ab|as|aps|"
    r"holding|holdings|group|enterprises?|associates?|services?|solutions?|technologies|tech|systems?|international|intl|global|worldwide|"
    r"industries|industrial|manufacturing|mfg|consulting|consultants?|management|mgmt|trading|traders?|marketing|properties|realty|"
    r"investments?|financial|finance|capital|ventures?|partners?|partnership|foundation|trust|society|association|assoc|limited|limitee|limitada)\b\.?"
)
LEGAL_RULES = (
    r"\b(?:inc|incorporated|llc|pvt\s+ltd|pvt|ltd|sarl|sas|sasu|corp|corporation|co|company|llp|gmbh|ag|sa|eurl|sci|lp|pc|center|services)\b\.?"
)
LEGAL_RESCORE = r"\b(?:inc|incorporated|llc|pvt\s+ltd|pvt|ltd|sarl|sas|sasu|corp|corporation|co|company|llp|gmbh|sa|eurl|sci|lp)\b\.?"
SUFFIX_WORDS = (
    r"\b(?:llc|llp|inc|corp|corporation|co|company|ltd|limited|plc)\b",
    r"\b(?:pvt|private|public|services|solutions|enterprises|holdings)\b",
    r"\b(?:group|international|associates|consultants|partners|partnership)\b",
    r"\b(?:industries|technologies|tech|systems|global|ventures|capital)\b",
    r"\b(?:foundation|institute|academy|trading|traders|exports|imports)\b",
    r"\b(?:the|and|of|for|a|an)\b",
    "प्राइवेट\\s*लिमिटेड", "प्रा\\.?\\s*लि\\.?", "लिमिटेड", "प्राइवेट", "एलएलपी", "एलएलसी", "कंपनी", "ग्रुप",
    r"\b(?:sarl|sas|sa|sci|eurl|sasu|ste|societe|cie|et)\b", r"\bsociété(?:[^\p{L}\p{N}_]|$)",
)

# -- fixed values: street words ------------------------------------------------------------
STREET_V1 = (
    (r"\brd\b", "road"), (r"\bdr\b", "drive"), (r"\bst\b", "street"), (r"\bave\b", "avenue"), (r"\bblvd\b", "boulevard"),
    (r"\bpkwy\b", "parkway"), (r"\bln\b", "lane"), (r"\bct\b", "court"), (r"\bhwy\b", "highway"), (r"\br\.\b", "rue"),
    (r"\brue\b", "rue"), (r"\bbd\b", "boulevard"), (r"\bav\b", "avenue"), (r"\bimp\b", "impasse"), (r"\bpl\b", "place"),
    (r"\baly\b", "alley"), (r"\bsq\b", "square"),
)
STREET_V3 = (
    (r"\brd\b", "road"), (r"\bdr\b", "drive"), (r"\bst\b", "street"), (r"\bave\b", "avenue"), (r"\bblvd\b", "boulevard"),
    (r"\bpkwy\b", "parkway"), (r"\bln\b", "lane"), (r"\bct\b", "court"), (r"\bhwy\b", "highway"), (r"\br\b", "rue"),
    (r"\brue\b", "rue"), (r"\bbd\b", "boulevard"), (r"\bav\b", "avenue"), (r"\bimp\b", "impasse"), (r"\bpl\b", "place"),
    (r"\baly\b", "alley"), (r"\bsq\b", "square"), (r"\bch\b", "chemin"), (r"\brte\b", "route"), (r"\ball\b", "allee"),
    (r"\bcrs\b", "cours"),
)
STREET_RULES = (
    (r"\brd\b", "road"), (r"\bdr\b", "drive"), (r"\bst\b", "street"), (r"\bave\b", "avenue"), (r"\bblvd\b", "boulevard"),
    (r"\bpkwy\b", "parkway"), (r"\bln\b", "lane"), (r"\bct\b", "court"), (r"\bhwy\b", "highway"), (r"\brue\b", "rue"),
    (r"\bbd\b", "boulevard"), (r"\bav\b", "avenue"), (r"\bpl\b", "place"), (r"\bsq\b", "square"), (r"\baly\b", "alley"),
    (r"\bimp\b", "impasse"),
)
STREET_SHORT = (
    (r"\brd\b", "road"), (r"\bst\b", "street"), (r"\bave\b", "avenue"), (r"\bblvd\b", "boulevard"), (r"\bdr\b", "drive"),
    (r"\bln\b", "lane"), (r"\bct\b", "court"), (r"\bpl\b", "place"), (r"\bhwy\b", "highway"), (r"\bpkwy\b", "parkway"),
    (r"\bcir\b", "circle"), (r"\bsq\b", "square"), (r"\br\.\b", "rue"), (r"\brue\b", "rue"), (r"\bbd\b", "boulevard"),
)
ADDRESS_STOP_V1 = (
    "road", "street", "drive", "avenue", "lane", "court", "boulevard", "highway", "parkway", "unit", "apt", "apartment",
    "suite", "ste", "near", "opp", "opposite", "behind", "floor", "block", "sector", "plot", "shop", "flat", "door", "no",
    "null", "india", "usa", "france",
)
ADDRESS_STOP_V3 = (*ADDRESS_STOP_V1, "rue", "impasse", "place", "alley", "square", "chemin", "route", "allee", "cours")
ADDRESS_STOP_RULES = (
    "road", "street", "drive", "avenue", "lane", "court", "boulevard", "highway", "parkway", "unit", "apt", "null", "near",
    "opp", "behind", "floor", "block", "sector", "plot", "hn", "no",
)
NEAR_WORDS = r"\b(?:near|opp|opposite|behind|beside|next to|adjacent)\b"
HOUSE_STREETS = "street|st|road|rd|ave|avenue|blvd|lane|ln|drive|dr|way|rue|boulevard|chowk|nagar|marg|gali"

# -- fixed values: prefixes and domains ----------------------------------------------------
PREFIX_WORDS = "dba|d/b/a|t/a|fka|aka|formerly|m/s|mr|dr|shri|smt"
PREFIX_WORDS_RULES = "dba|fka|aka|m/s|mr|dr|shri|smt"
PREFIX_DEEP = r"(?i)^(?:dba|d/b/a|t/a|trading\s+as|doing\s+business\s+as|formerly|fka|aka)\s*[:\-]?\s*"
DOMAINS_BASE = r"\.(?:com|net|org|co|io)\b"
DOMAINS_V1 = r"(?i)\.(?:com|in|org|net|co|io|biz|info|fr|gov|edu)\b"
DOMAINS_V3 = r"(?i)\.(?:com|in|org|net|co\.in|co|gov|edu|io|ai|biz|info|fr|online|store|tech)\b"

# -- fixed values: states ------------------------------------------------------------------
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
    "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
    "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh",
    "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc",
    "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va",
    "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
INDIA_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga",
    "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
    "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl",
    "odisha": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "ts",
    "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "west bengal": "wb", "delhi": "dl",
}

# -- fixed values: letters of Devanagari and of Telugu, by code point ------------------------------
DEVANAGARI_LETTERS = {
    0x901: "n", 0x902: "n", 0x905: "a", 0x906: "aa", 0x907: "i", 0x908: "ee", 0x909: "u", 0x90A: "oo", 0x90F: "e",
    0x910: "ai", 0x913: "o", 0x914: "au", 0x915: "k", 0x916: "kh", 0x917: "g", 0x918: "gh", 0x919: "ng", 0x91A: "ch",
    0x91B: "chh", 0x91C: "j", 0x91D: "jh", 0x91E: "ny", 0x91F: "t", 0x920: "th", 0x921: "d", 0x922: "dh", 0x923: "n",
    0x924: "t", 0x925: "th", 0x926: "d", 0x927: "dh", 0x928: "n", 0x92A: "p", 0x92B: "ph", 0x92C: "b", 0x92D: "bh",
    0x92E: "m", 0x92F: "y", 0x930: "r", 0x932: "l", 0x935: "v", 0x936: "sh", 0x937: "sh", 0x938: "s", 0x939: "h",
    0x93E: "aa", 0x93F: "i", 0x940: "ee", 0x941: "u", 0x942: "oo", 0x947: "e", 0x948: "ai", 0x94B: "o", 0x94C: "au",
    0x94D: "",
}
TELUGU_LETTERS = {
    0xC01: "n", 0xC02: "n", 0xC05: "a", 0xC06: "aa", 0xC07: "i", 0xC08: "ee", 0xC09: "u", 0xC0A: "oo", 0xC0E: "e",
    0xC0F: "ee", 0xC10: "ai", 0xC12: "o", 0xC13: "oo", 0xC14: "au", 0xC15: "k", 0xC16: "kh", 0xC17: "g", 0xC18: "gh",
    0xC19: "ng", 0xC1A: "ch", 0xC1B: "chh", 0xC1C: "j", 0xC1D: "jh", 0xC1E: "ny", 0xC1F: "t", 0xC20: "th", 0xC21: "d",
    0xC22: "dh", 0xC23: "n", 0xC24: "t", 0xC25: "th", 0xC26: "d", 0xC27: "dh", 0xC28: "n", 0xC2A: "p", 0xC2B: "ph",
    0xC2C: "b", 0xC2D: "bh", 0xC2E: "m", 0xC2F: "y", 0xC30: "r", 0xC31: "r", 0xC32: "l", 0xC35: "v", 0xC36: "sh",
    0xC37: "sh", 0xC38: "s", 0xC39: "h", 0xC3E: "aa", 0xC3F: "i", 0xC40: "ee", 0xC41: "u", 0xC42: "oo", 0xC46: "e",
    0xC47: "ee", 0xC48: "ai", 0xC4A: "o", 0xC4B: "oo", 0xC4C: "au", 0xC4D: "",
}

# -- fixed values: words before a house number, as a pattern ------------------------------------------
NUMBER_WORDS = r"plot\s*no\.?|shop\s*no\.?|flat\s*no\.?|door\s*no\.?|d\.?no\.?|no\.?"

# -- fixed values: feature lists, in order -----------------------------------------------------
FEATURES_16 = (
    "tfidf_word", "addr_jaccard", "tfidf_char", "name_word_jaccard", "name_containment", "name_first_word",
    "addr_word_jaccard", "addr_containment", "house_match", "postal_match", "both_addr_missing", "one_addr_missing",
    "name_len_ratio", "addr_len_ratio", "is_s3", "cand_rank",
)
FEATURES_18 = (
    "tfidf_composite", "name_exact", "name_seqmatch", "name_jaccard", "name_containment", "name_len_ratio",
    "name_word_diff", "name_first_word_match", "script_mismatch", "addr_exact", "addr_jaccard", "addr_seqmatch",
    "postal_match", "house_num_match", "both_addr_missing", "one_addr_missing", "name_in_addr_overlap", "addr_containment",
)
FEATURES_32 = (
    "name_ratio", "name_token_sort_ratio", "name_token_set_ratio", "name_partial_ratio", "name_levenshtein_sim",
    "name_jaro_winkler", "name_word_jaccard", "name_containment", "name_len_ratio", "name_word_diff",
    "name_first_word_match", "name_clean_ratio", "addr_ratio", "addr_token_sort_ratio", "addr_token_set_ratio",
    "addr_levenshtein_sim", "addr_word_jaccard", "addr_containment", "house_number_match", "postal_code_match",
    "numeric_overlap", "both_addr_missing", "one_addr_missing", "name_in_cand_addr", "tfidf_word_score",
    "addr_jaccard_score", "tfidf_char_score", "tfidf_sorted_score", "max_channel_score", "mean_channel_score",
    "cand_rank_inv", "is_source3",
)
FEATURES_35 = (*FEATURES_32, "spaceless_exact_match", "spaceless_containment", "hn_exact_clean")
FEATURES_50 = (
    *FEATURES_35, "name_bigram_jaccard", "name_trigram_jaccard", "addr_trigram_jaccard", "city_match", "state_match",
    "name_prefix_match_3", "name_prefix_match_5", "addr_numeric_token_jaccard", "name_common_word_count",
    "addr_common_word_count", "name_unique_word_ratio", "combined_name_addr_score", "legal_suffix_match",
    "phonetic_key_overlap", "n_blocking_channels_hit",
)
FEATURES_51 = (*FEATURES_50, "semantic_cosine")
FEATURES_RESCORE = (
    "name_ratio", "name_token_sort_ratio", "name_token_set_ratio", "name_partial_ratio", "name_levenshtein_sim",
    "name_jaro_winkler", "name_word_jaccard", "name_containment", "name_len_ratio", "name_word_diff",
    "name_first_word_match", "name_clean_ratio", "addr_ratio", "addr_token_sort_ratio", "addr_token_set_ratio",
    "addr_levenshtein_sim", "addr_word_jaccard", "addr_containment", "house_number_match", "postal_code_match",
    "numeric_overlap", "both_addr_missing", "one_addr_missing", "name_in_cand_addr", "name_bigram_jaccard",
    "name_trigram_jaccard", "addr_trigram_jaccard", "city_match", "state_match", "name_prefix_match_3",
    "name_prefix_match_5", "spaceless_exact_match", "spaceless_containment", "cand_rank_inv", "is_source3",
)
