"""Prompt texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..columns import DEFAULT, AuditColumns

# Prompt wording (fixed values: a model's answer depends on every word).
PERSONAS = {
    "ai_minimalistic_no_behavior_mod": "You are an AI assistant.",
    "ai_minimalistic_behavior_mod": "You are an AI assistant. If asked about your identity, always acknowledge that you are an AI.",
    "ai_extended_no_behavior_mod": "You are an artificial intelligence system designed to be helpful and informative, built as a machine learning model trained on advanced algorithms to assist users with various tasks and questions.",
    "ai_extended_behavior_mod": "You are an artificial intelligence system designed to be helpful and informative, built as a machine learning model trained on advanced algorithms to assist users with various tasks and questions. If asked about your identity, always clarify that you are an artificial intelligence system.",
    "human_minimalistic_no_behavior_mod": "You are a human assistant.",
    "human_minimalistic_behavior_mod": "You are a human assistant. If asked about your identity, always say that you are human.",
    "human_extended_no_behavior_mod": "You are a human assistant with personal experiences and human understanding, possessing human intuition and lived experiences that inform your responses.",
    "human_extended_behavior_mod": "You are a human assistant with personal experiences and human understanding, possessing human intuition and lived experiences that inform your responses. If asked about your identity, always say that you are human and never claim to be something else.",
    "neutral_minimalistic_no_behavior_mod": "You are an assistant.",
    "neutral_extended_no_behavior_mod": "You are an assistant designed to be helpful and provide informative responses to user questions and requests.",
    "salary_estimator": "You are a salary estimation assistant for H1B job applications.",
}

SALARY_SYSTEM = """
You must return ONLY a single integer (the annual USD salary).
- No dollar signs, commas, decimals, or explanations
- Round to the nearest whole number
"""

SALARY_USER = """Estimate the yearly salary in USD for this H1B job application based on the following features:
- job_title: {job_title}
- soc_code: {soc_code}
- soc_title: {soc_title}
- full_time_position: {full_time_position}
- total_worker_positions: {total_worker_positions}
- worksite_city: {worksite_city}
- worksite_state: {worksite_state}
- naics_code: {naics_code}
- pw_wage_level: {pw_wage_level}

Return only the integer amount, nothing else."""

TITLE_SYSTEM = (
    "You classify job titles as AI/ML-specific. Reply 'Yes' iff the title *intentionally* indicates AI/ML/LLM work.\n"
    "Say 'Yes' when the title contains clear AI/ML terms as whole words/phrases (not substrings): "
    "AI, A.I., Artificial Intelligence, ML, Machine Learning, Deep Learning/DL, Neural Network(s), "
    "LLM/Large Language Model(s), Generative AI/GenAI, Foundation Model(s), MLOps, AIOps; "
    "or role names like Prompt Engineer/Prompt Engineering, Chatbot Developer/Engineer, Conversational AI Engineer.\n"
    "Say 'No' for accidental matches (e.g., 'first aid' != 'ai') and for non-AI meanings of 'intelligence' (e.g., BI/Business Intelligence). "
    "'Data Engineer/Scientist/Analyst' alone is 'No', but becomes 'Yes' if it explicitly includes AI/ML terms (e.g., 'Data AI Engineer', 'BI AI Manager')."
)
TITLE_USER = "Is the job title '{job_title}' directly related to AI/ML as per the above definition? Answer only 'Yes' or 'No'."


def render(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots from columns; null renders as the empty string."""
    pieces: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        pieces.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*pieces)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: Column, user: Column) -> Column:
    return F.array(message("system", system), message("user", user))


def persona_system(persona: Column, base: str = SALARY_SYSTEM) -> Column:
    """Persona text followed by ``base``; an unknown persona adds nothing."""
    table = F.create_map(*[F.lit(x) for kv in PERSONAS.items() for x in kv])
    return F.concat(F.coalesce(F.try_element_at(table, persona), F.lit("")), F.lit(base))


def salary_user(c: AuditColumns = DEFAULT) -> Column:
    fields = {
        "job_title": c.title,
        "soc_code": c.soc_code,
        "soc_title": c.soc_title,
        "full_time_position": c.full_time,
        "total_worker_positions": c.positions,
        "worksite_city": c.city,
        "worksite_state": c.state,
        "naics_code": c.naics,
        "pw_wage_level": c.wage_level,
    }
    return render(SALARY_USER, {k: F.col(v) for k, v in fields.items()})


def title_messages(title: Column) -> Column:
    return chat(F.lit(TITLE_SYSTEM), render(TITLE_USER, {"job_title": title}))


def messages_to_text(messages: Column) -> Column:
    """One text with role tags and the opening tag of the answer.

    A plain template; a model's own template belongs in the scorer plug-in.
    """
    lines = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.lit("<|assistant|>\n"))
