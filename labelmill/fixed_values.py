"""Label sets, prompt texts, column names and word lists that outputs must match exactly."""

EMOTIONS = ("happiness", "anger", "disgust", "fear", "sadness", "surprise", "other")
SENTIMENTS = ("positive", "negative", "neutral")
FOUR_EMOTIONS = ("anger", "joy", "optimism", "sadness")

EMOTION_IDS = {"happiness": 0, "anger": 1, "disgust": 2, "fear": 3, "sadness": 4, "surprise": 5, "other": 6}
SENTIMENT_IDS = {"positive": 2, "neutral": 1, "negative": 0}

TRUE_WORDS = ("yes", "true", "t", "y", "1")
FALSE_WORDS = ("no", "false", "f", "n", "0")

# Spellings of a missing value in CSV files written by data frame libraries.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)

EMOTION_COLUMN = "llama3_emotion"
SENTIMENT_COLUMN = "llama3_sentiment"
RAW_COLUMN = "llama3_raw"
EMOTION_RAW_COLUMN = "llama3_emotion_raw"
SENTIMENT_RAW_COLUMN = "llama3_sentiment_raw"

EMOTION_CONTEXT = """
            You are an emotional classifier for online social media text.
            Analyze the emotion of the text enclosed in angle brackets, 
            determine if it is happiness, anger, disgust, fear, sadness, surprise or other emotion, and 
            return the answer as the corresponding emotion label "happiness" or "anger" or "disgust" or "fear" or "sadness" or "surprise" or "other".
        
        """

SENTIMENT_CONTEXT = """
            You are a sentiment classifier for online social media text.
            Analyze the sentiment of the text enclosed in angle brackets, 
            determine if it is positive, neutral, or negative, and 
            return the answer as the corresponding sentiment label "positive" or "neutral" or "negative".
        
        """

EMOTION_SENTIMENT_CONTEXT = """
            You are an emotion and sentiment classifier for online social media text.
            Analyze the emotion and sentiment of the text enclosed in angle brackets. 
            For emotion, determine if it is happiness, anger, disgust, fear, sadness, surprise or other emotion.
            For sentiment, determine if it is positive, neutral, or negative.
            Return the answer as "emotion" "sentiment" where emotion is from the corresponding emotion label "happiness" or "anger" or "disgust" 
            or "fear" or "sadness" or "surprise" or "other"; and sentiment is from the corresponding sentiment label "positive" or "neutral" or "negative"; 
            emotion followed by sentiment, separated by a space.
            
            """

EXAMPLE_TEXTS = (
    "You’ve had over a month to get this finalized ! Why are things delayed ?",
    "WOW! Drone Delivery Startup, @zipline Raises $25m To Expand Its Operations In Africa",
    "The environment can and has survived much hotter conditions.",
)
EXAMPLE_EMOTIONS = ("anger", "surprise", "other")
EXAMPLE_SENTIMENTS = ("negative", "positive", "neutral")

# What stands before and after the example lines of each prompt; a line is indented by twelve spaces.
EMOTION_EXAMPLES_FRAME = ("\n            For example:\n", "        ")
SENTIMENT_EXAMPLES_FRAME = ("\n            For example: \n", "        \n        ")
EMOTION_SENTIMENT_EXAMPLES_FRAME = ("\n            For example:\n", "\n        ")

# Contexts whose label names are filled in from the labels seen in the training tables.
EMOTION_TEMPLATE = """
            You are an emotional classifier for online social media text.
            Analyze the emotion of the text enclosed in angle brackets, 
            determine if it is {labels} emotion, and 
            return the answer as the corresponding emotion label {labels}.
        
        """

SENTIMENT_TEMPLATE = """
            You are a sentiment classifier for online social media text.
            Analyze the sentiment of the text enclosed in angle brackets, 
            determine if it is {labels}, and 
            return the answer as the corresponding sentiment label {labels}.
        
        """

EMOTION_SENTIMENT_TEMPLATE = """
            You are an emotion and sentiment classifier for online social media text.
            Analyze the emotion and sentiment of the text enclosed in angle brackets. 
            For emotion, determine if it is {emotion_labels} emotion.
            For sentiment, determine if it is {sentiment_labels} sentiment.
            Return the answer as "emotion" "sentiment" where emotion is from the corresponding emotion label {emotion_labels}; and sentiment is from the corresponding sentiment label {sentiment_labels};
            emotion followed by sentiment, separated by a space.
            
        """

# The headline prompt is trimmed as a whole, so the context starts at its first word.
HEADLINE_CONTEXT = """Analyze the sentiment of the news headline enclosed in square brackets, 
            determine if it is positive, neutral, or negative, and return the answer as 
            the corresponding sentiment label "positive" or "neutral" or "negative".

            """
