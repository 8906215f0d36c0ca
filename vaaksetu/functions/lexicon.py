"""Word lists, tables and patterns of the transcript functions."""

# Results depend on them entry by entry.

UNITS = {
    "शून्य": 0, "एक": 1, "दो": 2, "तीन": 3, "चार": 4, "पांच": 5, "पाँच": 5, "छह": 6, "छे": 6, "छै": 6,
    "सात": 7, "आठ": 8, "नौ": 9, "नो": 9,
}

#: From 10 to 99.
TENS = {
    "दस": 10, "ग्यारह": 11, "बारह": 12, "तेरह": 13, "चौदह": 14, "पंद्रह": 15, "सोलह": 16, "सत्रह": 17, "अठारह": 18, "उन्नीस": 19,
    "बीस": 20, "इक्कीस": 21, "बाईस": 22, "तेईस": 23, "चौबीस": 24, "पच्चीस": 25, "छब्बीस": 26, "सत्ताईस": 27, "अट्ठाईस": 28, "उनतीस": 29,
    "तीस": 30, "इकतीस": 31, "बत्तीस": 32, "तैंतीस": 33, "चौंतीस": 34, "पैंतीस": 35, "छत्तीस": 36, "सैंतीस": 37, "अड़तीस": 38, "उनतालीस": 39,
    "चालीस": 40, "इकतालीस": 41, "बयालीस": 42, "तैंतालीस": 43, "चवालीस": 44, "पैंतालीस": 45, "छियालीस": 46, "सैंतालीस": 47, "अड़तालीस": 48, "उनचास": 49,
    "पचास": 50, "इक्यावन": 51, "बावन": 52, "तिरपन": 53, "चौवन": 54, "पचपन": 55, "छप्पन": 56, "सत्तावन": 57, "अट्ठावन": 58, "उनसठ": 59,
    "साठ": 60, "इकसठ": 61, "बासठ": 62, "तिरसठ": 63, "चौंसठ": 64, "पैंसठ": 65, "छियासठ": 66, "सड़सठ": 67, "अड़सठ": 68, "उनहत्तर": 69,
    "सत्तर": 70, "इकहत्तर": 71, "बहत्तर": 72, "तिहत्तर": 73, "चौहत्तर": 74, "पचहत्तर": 75, "छिहत्तर": 76, "सतहत्तर": 77, "अठहत्तर": 78, "उन्यासी": 79,
    "अस्सी": 80, "इक्यासी": 81, "बयासी": 82, "तिरासी": 83, "चौरासी": 84, "पचासी": 85, "छियासी": 86, "सत्तासी": 87, "अट्ठासी": 88, "नवासी": 89,
    "नब्बे": 90, "इक्यानवे": 91, "बानवे": 92, "तिरानवे": 93, "चौरानवे": 94, "पचानवे": 95, "छियानवे": 96, "सत्तानवे": 97, "अट्ठानवे": 98, "निन्यानवे": 99,
}

MULTIPLIERS = {
    "सौ": 100, "हज़ार": 1000, "हजार": 1000, "हज़ारों": 1000, "लाख": 100000, "लाखों": 100000,
    "करोड़": 10000000, "करोड़ों": 10000000, "अरब": 1000000000,
}

NUMBER_WORDS = UNITS | TENS | MULTIPLIERS

#: Number words of idioms stay as they are; a space stands for any run of white space.
IDIOMS = [
    "दो-चार बातें", "दो चार बातें", "नौ दो ग्यारह", "एक ना एक दिन", "एक न एक", "चार चांद", "दो टूक", "तीन तेरह", "सात समंदर", "चार धाम",
    "नौ रस", "छत्तीस का आंकड़ा", "एक दूसरे", "एक-दूसरे", "एक साथ", "एक बार", "एक तरह", "एक तरफ", "दो तरफा",
]

#: Runs with one of these stay as they are.
APPROXIMATE = ["हजारों", "लाखों", "करोड़ों", "सैकड़ों", "बीसियों", "दर्जनों"]

#: Loan words from English in Devanagari.
LOANS = {
    "कंप्यूटर", "फ़ोन", "फोन", "मोबाइल", "लैपटॉप", "इंटरनेट", "वेबसाइट", "ऐप", "सॉफ्टवेयर", "हार्डवेयर", "डेटा", "नेटवर्क", "वाईफाई", "ब्लूटूथ",
    "सर्वर", "प्रोग्राम", "कोड", "टेक्नोलॉजी", "ऑनलाइन", "ऑफलाइन", "डिजिटल", "वीडियो", "ऑडियो", "कैमरा", "स्कूल", "कॉलेज", "यूनिवर्सिटी", "इंटरव्यू",
    "जॉब", "कंपनी", "ऑफिस", "बॉस", "मैनेजर", "प्रोजेक्ट", "मीटिंग", "प्रेजेंटेशन", "रिज्यूम", "सैलरी", "प्रमोशन", "टीम", "लीडर", "बजट", "टारगेट",
    "रिपोर्ट", "ट्रेनिंग", "सर्टिफिकेट", "डिग्री", "एग्जाम", "रिजल्ट", "क्लास", "टीचर", "स्टूडेंट", "सब्जेक्ट", "टॉपिक", "नोट्स", "होमवर्क",
    "असाइनमेंट", "लेक्चर", "बस", "ट्रेन", "ऑटो", "टैक्सी", "बाइक", "कार", "ड्राइवर", "टिकट", "स्टेशन", "एयरपोर्ट", "होटल", "रेस्टोरेंट", "शॉपिंग",
    "मॉल", "पार्क", "हॉस्पिटल", "डॉक्टर", "नर्स", "मेडिसिन", "मैसेज", "कॉल", "ईमेल", "चैट", "सोशल", "मीडिया", "पोस्ट", "शेयर", "लाइक", "कमेंट",
    "फॉलो", "सब्सक्राइब", "अकाउंट", "पासवर्ड", "प्रोफाइल", "स्टोरी", "ग्रुप", "हैप्पी", "सैड", "नर्वस", "कॉन्फिडेंट", "स्ट्रेस", "रिलैक्स",
    "मोटिवेशन", "इंस्पिरेशन", "पैशन", "सक्सेस", "फेल", "प्रॉब्लम", "सॉल्व", "सॉल्यूशन", "इश्यू", "फिक्स", "एरर", "रीजन", "ऑप्शन", "चॉइस", "डिसीजन",
    "प्लान", "गोल", "फैमिली", "फ्रेंड", "रिलेशनशिप", "पार्टी", "टूर", "ट्रिप", "हॉबी", "स्पोर्ट्स", "गेम", "म्यूजिक", "डांस", "फिल्म", "मूवी",
    "सीरीज", "बुक", "न्यूज़", "टाइम", "लाइफ", "एक्सपीरियंस", "टाइप", "पॉइंट", "लेवल", "फीचर", "क्वालिटी", "सिस्टम", "प्रोसेस", "मेथड", "बेसिक",
    "एडवांस", "सिंपल", "फ्यूचर", "कॅरियर", "करियर", "फीडबैक", "अपडेट", "वर्जन", "कॉन्टेंट", "ब्रांड", "मार्केट", "बिजनेस", "कस्टमर", "प्रॉडक्ट",
    "सर्विस", "डिलीवरी", "ऑर्डर", "परसेंट", "प्रतिशत", "नंबर", "टोटल", "एवरेज", "पॉपुलर", "फेमस", "इंपोर्टेंट", "स्पेशल", "नॉर्मल", "ऐक्चुअली",
    "बेसिकली", "ऑब्वियसली", "प्रॉपर", "सीरियस", "प्रैक्टिकल", "थ्योरी", "प्योर", "हार्ट",
}

#: Devanagari to Roman by code point; the four letters with a nuqta are two code points and are looked up first.
ROMAN = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "w": "w",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ं": "n", "ँ": "n", "ः": "h",
    "ा": "a", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
    "्": "", "ॉ": "o", "ॅ": "e", "ऑ": "o",
}
ROMAN_PAIRS = {"फ़": "f", "ज़": "z", "ड़": "r", "ढ़": "rh"}

ENGLISH = {
    "interview", "job", "computer", "phone", "mobile", "laptop", "internet", "website", "app", "software", "hardware", "data", "network", "server",
    "program", "code", "technology", "online", "offline", "digital", "video", "audio", "camera", "school", "college", "university", "office", "boss",
    "manager", "project", "meeting", "presentation", "resume", "salary", "promotion", "team", "leader", "budget", "target", "report", "training",
    "certificate", "degree", "exam", "result", "class", "teacher", "student", "subject", "topic", "notes", "homework", "assignment", "lecture", "bus",
    "train", "auto", "taxi", "bike", "car", "driver", "ticket", "station", "airport", "hotel", "restaurant", "shopping", "mall", "park", "hospital",
    "doctor", "nurse", "medicine", "message", "call", "email", "chat", "social", "media", "post", "share", "like", "comment", "follow", "subscribe",
    "account", "password", "profile", "story", "group", "happy", "sad", "nervous", "confident", "stress", "relax", "motivation", "success", "fail",
    "problem", "solve", "solution", "issue", "fix", "error", "reason", "option", "choice", "decision", "plan", "goal", "family", "friend",
    "relationship", "party", "tour", "trip", "hobby", "sports", "game", "music", "dance", "film", "movie", "series", "book", "news", "time", "life",
    "experience", "type", "point", "level", "feature", "quality", "system", "process", "method", "basic", "advance", "simple", "future", "career",
    "feedback", "update", "version", "content", "brand", "market", "business", "customer", "product", "service", "delivery", "order", "percent",
    "number", "total", "average", "popular", "famous", "important", "special", "normal", "actually", "basically", "obviously", "proper", "serious",
    "practical", "theory", "pure", "heart",
}

SUFFIXES = [
    "ों", "ें", "ां", "ाँ", "ने", "ता", "ती", "ते", "ना", "नी", "ली", "ले", "ला", "या", "ये", "यी", "ाई", "ीं", "ूँ", "ीय", "वाला", "वाली", "वाले",
    "कर", "पन", "दार", "गार", "गी",
]
PREFIXES = [
    "अन", "बे", "बद", "ला", "ना", "निर", "परा", "प्रति", "सम", "अधि", "अनु", "उप", "सह", "अप",
]

#: Words that are right beyond doubt, but for the regular verb forms below.
CORE_WORDS = [
    "मैं", "हम", "तुम", "आप", "वह", "वो", "यह", "ये", "वे", "इसमें", "उसमें", "उनमें", "मुझे", "हमें", "तुम्हें", "उन्हें", "मेरा", "हमारा",
    "तुम्हारा", "उसका", "उसकी", "उसके", "मेरी", "मेरे", "अपना", "अपनी", "अपने",
    "है", "हैं", "था", "थी", "थे", "हो", "करें", "किया", "कर", "करके", "जाए", "गया", "गई", "गए", "आया", "आई", "आए", "दिया", "दे", "दी", "लिया", "ले", "खा", "पिया",
    "में", "पर", "से", "को", "के", "की", "का", "ने", "तक", "पे",
    "और", "या", "कि", "लेकिन", "मगर", "तो", "भी", "ही", "सिर्फ", "बस", "फिर", "अगर", "जैसे", "जब", "तब", "क्योंकि", "इसलिए", "इसीलिए", "ताकि", "चाहे",
    "बहुत", "ज्यादा", "कम", "अभी", "अब", "कल", "आज", "परसों", "कभी", "हमेशा", "जल्दी", "धीरे", "ऊपर", "नीचे", "आगे", "पीछे",
    "यहां", "वहां", "कहां", "कहीं", "सामने", "पहले", "बाद", "ठीक", "सही", "गलत", "अच्छा", "बुरा", "अच्छी", "अच्छे",
    "लोग", "लोगों", "बात", "बातें", "दिन", "रात", "समय", "साल", "घर", "देश", "शहर", "गांव", "पानी", "काम", "नाम", "जगह", "तरह", "तरीका", "तरीके", "चीज", "चीजें", "चीज़",
    "आदमी", "औरत", "बच्चा", "बच्चे", "बच्चों", "बच्ची", "पैसा", "पैसे", "रुपये", "दोस्त", "दोस्तों", "मां", "माँ", "पिता", "भाई", "बहन", "परिवार", "पढ़ाई", "शादी", "जीवन",
    "क्या", "कैसे", "कहाँ", "कब", "कौन", "क्यों", "किसने", "कितना",
    "एक", "दो", "तीन", "चार", "पांच", "छह", "सात", "आठ", "नौ", "दस",
    "नहीं", "मत", "ना", "न", "नही",
    "मतलब", "हां", "हाँ", "जी", "ओके", "हेलो", "धन्यवाद", "शुक्रिया", "बिल्कुल", "बिलकुल",
]

#: Verb stems with the endings that make forms of theirs that are right beyond doubt.
CORE_VERBS = {
    "हो": ["ना", "ता", "ती", "ते"], "कर": ["ना", "ता", "ती", "ते"], "जा": ["ना", "ता", "ती", "ते"], "आ": ["ना", "ता", "ती", "ते"], "दे": ["ना", "ता", "ती", "ते"],
    "ले": ["ना", "ता", "ती", "ते"], "बोल": ["ना", "ता", "ती", "ते", "ा"], "सुन": ["ना", "ता", "ती", "ते", "ा"], "देख": ["ना", "ता", "ती", "ते", "ा"],
    "रह": ["ना", "ता", "ती", "ते", "ा", "ी", "े"], "चल": ["ना", "ता", "ती", "ते", "ा", "ी", "े"], "मिल": ["ना", "ता", "ती", "ते", "ा", "ी"],
    "सोच": ["ना", "ता", "ती", "ते", "ा"], "पड़": ["ना", "ता", "ती", "ते"], "बन": ["ना", "ता", "ती"], "बना": ["ना", "ता"], "खा": ["ना", "ता", "ती", "ते"],
    "पी": ["ना", "ता", "ती"], "लग": ["ना", "ता", "ती", "ा", "ी"],
}
CORE_VOCABULARY = CORE_WORDS + [stem + ending for stem, endings in CORE_VERBS.items() for ending in endings]

#: Words whose presence on one side only marks a mismatch of number formats.
MISMATCH_WORDS = [
    "एक", "दो", "तीन", "चार", "पांच", "छह", "सात", "आठ", "नौ", "दस", "बीस", "तीस", "चालीस", "पचास", "साठ", "सत्तर", "अस्सी", "नब्बे", "सौ", "हज़ार",
    "लाख", "करोड़", "पच्चीस", "पंद्रह", "बारह", "चौदह",
]

HOMOPHONES = [
    ("वह", "वो"), ("यह", "ये"), ("मैं", "में"), ("है", "हैं"), ("हूँ", "हूं"), ("हाँ", "हां"), ("ज़्यादा", "ज्यादा"),
    ("उसने", "उन्होंने"), ("कि", "की"), ("से", "सें"),
]

#: Digits that a lattice accepts for number words, and the other way round.
LATTICE_NUMBERS = {
    "1": ["एक"], "2": ["दो"], "3": ["तीन"], "4": ["चार"], "5": ["पांच", "पाँच"], "6": ["छह", "छे"], "7": ["सात"], "8": ["आठ"], "9": ["नौ"],
    "10": ["दस"], "11": ["ग्यारह"], "12": ["बारह"], "13": ["तेरह"], "14": ["चौदह"], "15": ["पंद्रह"], "20": ["बीस"], "25": ["पच्चीस"],
    "50": ["पचास"], "100": ["सौ"],
}

#: Spellings that a lattice accepts besides the first.
LATTICE_SPELLINGS = {
    "किताबें": ["किताबे", "कताबें", "कताबे"], "खरीदीं": ["खरीदी", "ख़रीदीं"], "बिल्कुल": ["बिलकुल"], "ज़्यादा": ["ज्यादा", "जियादा"],
    "रक्षाबंधन": ["रक्षा बंधन"], "खेतीबाड़ी": ["खेती बाड़ी"], "सियाराम": ["सिया राम", "शिय राम"],
}

CATEGORIES = [
    "Punctuation Only", "Number Format Mismatch", "English Loan Word Error", "Homophone Substitution", "Word Repetition",
    "Word Deletion", "Word Insertion/Hallucination",
]

# End of the fixed values.

#: What a category says about its errors, in our words.
REASONS = {
    "Punctuation Only": "Apart from punctuation the two texts agree.",
    "Number Format Mismatch": "One side writes a number in digits, the other in words.",
    "English Loan Word Error": "An English word is in Roman script on one side only.",
    "Homophone Substitution": "A word was replaced by one that sounds alike.",
    "Word Repetition": "A word is repeated, as in a decoding loop.",
    "Word Deletion": "Much of the reference is missing from the prediction.",
    "Word Insertion/Hallucination": "The prediction has many words that the reference lacks.",
    "Other": "No category fits; rare words or mixed language are likely.",
}
