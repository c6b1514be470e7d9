"""Fixed values that must equal the behaviour being reproduced.

These are stated plainly and together; everything else in the package derives
from parameters.
"""

# --- fixed values: pipeline defaults -------------------------------------
CHUNK_SIZE = 1000            # characters per text split
CHUNK_OVERLAP = 200          # characters shared by neighbouring splits
SPLIT_SEPARATORS = ["\n\n", "\n", " ", ""]
TOP_K = 4                    # retrieved passages per question
SIMILARITY_THRESHOLD = 0.85  # answer neighbourhood threshold
CONFIDENCE_GATE = 0.6        # answers at or above are returned early
MAX_AGE_DAYS = 30            # scraped data freshness
FLUSH_CHARS = 1_000_000      # JSON characters per host chunk file
URL_BATCH_SIZE = 4           # seeds per crawl batch (2 at run time)
CRAWL_DEPTH = 3              # link hops followed from a seed
CONTEXT_SEPARATOR = "\n\n"   # between retrieved passages in a prompt

# --- fixed values: texts --------------------------------------------------
SYSTEM_PROMPT = (
    "You are an assistant for question-answering tasks. "
    "Use the following pieces of retrieved context to answer "
    "the question. If you don't know the answer, say that you don't know."
    "\n\n"
    "{context}"
)
NO_INFORMATION_ANSWER = "I don't have enough information to answer this question."
PIPELINE_ERROR_ANSWER = "An error occurred while processing your question."
NO_VALID_ANSWERS = "No valid answers found."
ESCAPED_FRAGMENT_PARAM = "_escaped_fragment_"
