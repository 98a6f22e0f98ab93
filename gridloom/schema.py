"""Schemas, keys and knowledge that the curation operators take as defaults. All of it can be passed in instead."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of the three canonical tables; all are text, and a missing value is the empty text.
BENCHMARK_COLUMNS = (
    "benchmark_id benchmark_name abbreviation year venue category subcategory paper_url github_url hf_url languages_count languages cultures_regions task_types metrics dataset_size "
    "annotation_method key_finding notes other_url description task_type domain source_url title acronym huggingface_url language_count geography metric_type data_source organization name "
    "release_date paper_title source_type source_name"
).split()
MODEL_COLUMNS = (
    "model_id model_name model_family developer sizes types benchmark_count total_results avg_score model_type model_size provider type base_model year_evaluated inference_platform "
    "inference_engine organization release_date architecture context_window license url parameters_billion"
).split()
RESULT_COLUMNS = (
    "benchmark_id model_name model_family model_size active_size model_type score metric_name setup num_shot_sample language source_url year_evaluated notes evaluation_id source_name source_type "
    "source_organization model_developer model_id hf_repo hf_split samples_number metric_lower_is_better metric_score_type metric_min_score metric_max_score reasoning_enabled inference_platform "
    "inference_engine generation_temperature generation_max_tokens generation_top_p benchmark_name metric_score metric score_type date_recorded"
).split()

# The columns that make two result rows the same evaluation, and the shorter key of staged rows.
IDENTITY_KEY = ("model_name", "model_id", "benchmark_id", "metric_name", "setup", "reasoning_enabled", "num_shot_sample", "source_url", "language")
STAGING_KEY = ("benchmark_id", "model_name", "metric_name", "source_url")

# Host fragments of the source tiers, most trusted first; anything else is of the unknown tier.
TRUST_TIERS = {
    1: ("arxiv.org", "aclanthology.org", "openreview.net", "anthropic.com", "openai.com", "ai.google", "swebench.com", "crux-eval.github.io", "chat.lmsys.org", "lmsys.org", "lmarena.ai", "raw.githubusercontent.com/lmarena", "raw.githubusercontent.com/ibm/mt-rag"),
    2: ("huggingface.co/spaces/open-llm-leaderboard",),
    3: ("llm-stats.com", "vellum.ai", "emergentmind.com", "gorilla.cs.berkeley.edu", "artificialanalysis.ai", "pricepertoken.com"),
}
UNKNOWN_TIER = 4

# Developers, families and name parts that the rule classifier knows.
TRUSTED_DEVELOPERS = (
    "Meta", "OpenAI", "Anthropic", "Google", "Mistral AI", "DeepSeek", "Alibaba Cloud", "Microsoft", "NVIDIA", "01.AI", "Zhipu AI", "TII UAE", "StabilityAI", "IBM Granite", "Cohere", "xAI", "AI21 Labs", "Baichuan",
    "Baidu", "Tencent", "ByteDance", "Moonshot AI", "Qwen Team", "Core42", "Sakana AI", "Upstage", "Facebook",
)
FROM_SCRATCH = (
    "llama", "mistral", "mixtral", "gemma", "palm", "gemini", "qwen", "phi", "deepseek", "yi", "pythia", "gpt-j", "gpt-neox", "gpt-neo", "bloom", "falcon", "dbrx", "olmo", "redpajama", "gpt-jt", "codegen", "smollm", "mpt",
    "opt", "xglm", "dolly", "internlm", "exaone", "jais", "granite", "glm", "chatglm", "hyperclova", "command-r", "grok", "aya", "minicpm", "baichuan", "starcoder", "santacoder", "tinyllama", "vicuna", "internvl",
)
FINE_TUNE_WORDS = (
    "instruct", "chat", "fine-tuned", "ft-", "-ft", "-chat", "-instruct", "align", "dpo", "rlhf", "orpo", "sft", "alpaca", "hermes", "openhermes", "zephyr", "openchat", "open-orca", "orca", "kto", "simpo", "ppo", "wizard",
    "magpie", "solar",
)

# Tokens that name normalisation drops, tokens that it keeps as variants, and whole sizes in billions.
DROPPED_TOKENS = (
    "instruct", "inst", "instruction", "chat", "chatbot", "base", "base-model", "ft", "sft", "dpo", "rlhf", "ppo", "trained", "tuned", "finetuned", "eval", "evals", "orca", "openorca", "neural", "aligned", "deduped", "prompt",
    "fc", "thinking", "reasoning", "effort", "cot", "greedy", "prm", "orm", "api", "exp", "high", "abliterated", "en", "ch", "zh", "korean", "kr", "ja", "ar", "es", "de", "fr", "ru", "multi", "multilingual", "turbo", "davinci",
    "curie", "babbage", "ada", "dbrx", "gpt4all", "ggml", "gguf", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "january", "february", "march", "april", "june", "july", "august", "september",
    "october", "november", "december",
)
VARIANT_TOKENS = ("opus", "sonnet", "haiku", "mythos", "fable", "pro", "mini", "flash", "maverick", "scout", "vl", "yi", "o1", "o3", "o4", "t5")
COMMON_SIZES = (7, 8, 9, 11, 12, 13, 14, 22, 26, 27, 30, 32, 33, 34, 70, 72, 80, 90, 235, 405)

# Metrics whose scores keep their scale, and the marks stripped from model names.
ABSOLUTE_METRICS = ("Perplexity", "perplexity", "BPB", "Bits/byte", "bits/byte", "BLEURT", "BERTScore", "Elo", "elo", "# eval")
STATUS_MARKS = "☠⚠†★✗✓⓪①②③④⑤"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
