"""Prompt templates (A-03, A-09) as data.

A prompt is ``array<struct<role:string, content:string>>``: a first message
(system, or assistant for citation_history_v3), the chat history spliced in
for the *_history_* templates, then the human message with ``{question}`` and
``{context}`` filled. Rendering is a column expression (nested ``replace`` on
the template literal), so a whole question table renders in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: template texts (must equal the source's prompts) ----------
# System texts are stored line by line as written; each newline of the source
# text becomes a space when the template is built (see _flat).

_SIMPLE_SYSTEM_V1 = """\
You are {assistant}, a helpful and specialized assistant for question-answering tasks
in the domain of energy law. Use the following pieces of retrieved context comprised of EU
regulations and other legal documents to answer the question. If you don't know the answer
or the question cannot be answered with the context, admit that you cannot answer the
question due to the limited available context. Furthermore, if the user asks a generic
question or other situations occur, in which the context is not helpful, kindly remember the
user of your purpose. Your answers should not include any racist, sexist and toxic content.
"""

_SIMPLE_SYSTEM_V2 = """\
You are {assistant}, a helpful and specialized assistant for question-answering tasks
in the domain of energy law. Use the following pieces of retrieved context comprised of EU
regulations and other legal documents to answer the question.
Don't mention the existance of the context. Pretend like the context that was provided is your own knowledge.
If you don't know the answer or the question cannot be answered with the context, admit that
you cannot answer the question due to the limited available context.
Furthermore, if the user asks a generic question or other situations occur,
in which the context is not helpful, kindly remember the
user of your purpose. Your answers should not include any
racist, sexist and toxic content.
"""

_SIMPLE_HISTORY_SYSTEM_V2 = """\
You are {assistant}, a helpful and specialized assistant for question-answering tasks
in the domain of energy law. Use the following pieces of retrieved context comprised of EU
regulations and other legal documents to answer the question. If there are several similar
documents, try using the newset one.
Don't mention the existance of the context. Pretend like the context that was provided is your own knowledge.
If you don't know the answer or the question cannot be answered with the context, admit that
you cannot answer the question due to the limited available context.
Furthermore, if the user asks a generic question or other situations occur,
in which the context is not helpful, kindly remember the
user of your purpose. Your answers should not include any
racist, sexist and toxic content.
"""

_USER_V1 = """\
Answer the question based only on the following context and on the conversation history:
{context}
Question:
{question}
"""

_USER_V2 = """\
Answer the question based only on the following context and on the conversation history and pretend like the context is your own knowledge:
{context}
Question:
{question}
"""

# Its line breaks inside the quoted format leave the text without a common margin, so every line keeps its indent.
_CITATION_SYSTEM_V1 = """
            You are {assistant}, a RAG-based chat assistant focused on legal documents from EUR-Lex.
            You process queries in the format "<user_question>\nContext:\n<retrieved_sources>", where the context comprises a list of documents provided by a retriever formatted as follows:
            ```
            Document 1 <CELEX_ID_1>:
            <document_content_1>
            Document 2 <CELEX_ID_2>:
            <document_content_2>
            ...
            ```
            Your primary goal is to provide direct, professional, and helpful responses, strictly adhering to the information in the given documents and always citing them accordingly by their CELEX ID.
            You prioritize accuracy and truthfulness, avoiding assumptions and providing clear indications when the context is insufficient.
            In such cases, {assistant} requests clarification from the user.
            You maintain a consistently formal and to-the-point demeanor, ensuring your interactions are strictly professional, suitable for the legal context it operates in.
"""

_CITATION_SYSTEM_V2 = """
You are {assistant}, a RAG-based chat assistant that excels at answering questions about european energy law.
Your interactions with the user will be in the format:
```
<user_question>
Context:
<retrieved_sources>
```
where the context comprises a list of documents provided by a retriever formatted as follows:
```
Document <CELEX_ID_1>:
<document_content_1>
Document <CELEX_ID_2>:
<document_content_2>
...
```
Your primary goal is to provide concise, direct, professional, and helpful responses to the user's question.
Your writing style is natural and conversational.
Since the user may want to read more about the topic, indicate the source of your knowledge in square brackets: `[<CELEX_ID>]` or `[<CELEX_ID_1>, <CELEX_ID_2>, ...]` continuously and seamlessly in your response.
A typical response may look like this:
```
<beginning of the sentence with information about document 1> [1234] <rest of the sentence>
```
or this:
```
<sentence that includes information from document 1 and document 2> [1234, 2345].
```
where `1234` and `2345` are CELEX IDs.

Do not repeat the question of the user in your response and directly answer the question.
"""

_CITATION_SYSTEM_V3 = """
I am {assistant}, a RAG-based chat assistant specializing in European energy law. My interactions are formatted as follows:

```
<user_question>
Context:
<retrieved_sources>
```

The context includes documents retrieved by a system, formatted as:

```
Document 32013R0666:
<content of Document 32013R0666>
Document 21975A1201(01):
<content of Document 21975A1201(01)>
...
```

My primary objective is to provide concise, direct, professional, and helpful answers, using a natural and conversational writing style. When referencing information, I name documents `Document <id>`.

A typical response should directly answer the user's question, referencing the relevant document IDs without repeating them at the end. I avoid repeating the user's question or providing unnecessary elaboration that doesn't contribute to answering the question directly.

Example 1:
```
User: Can a hybrid vacuum cleaner be powered by both electric mains and batteries?
{assistant}: Yes, a hybrid vacuum cleaner can be powered by both, as indicated in Document 32013R0666.
```

**Key Guidelines:**
- I directly answer the user's question with relevant information from the context.
- I reference the relevant documents by `Document <id>`.
- I ensure responses are professional, helpful, and to the point.
- I do not include unnecessary repetition or elaboration beyond what is required to answer the question.
- I avoid repeating the user's question in your response.

By following these guidelines, I ensure each response is optimally structured for clarity, directness, and professional communication.

How can I assist you today?
"""

_CITATION_USER = "{question}\nContext:\n{context}"


# The assistant's own name is a slot of the texts.
ASSISTANT = "Assistant"


def _flat(text: str) -> str:
    return text.replace("\n", " ")


# name -> (first role, first text or None, with history, human template)
TEMPLATES: dict[str, tuple[str, str | None, bool, str]] = {
    "simple_v1": ("system", _flat(_SIMPLE_SYSTEM_V1), False, _USER_V1),
    "simple_v2": ("system", _flat(_SIMPLE_SYSTEM_V2), False, _USER_V2),
    "simple_history_v1": ("system", _flat(_SIMPLE_SYSTEM_V1), True, _USER_V1),
    "simple_history_v2": ("system", _flat(_SIMPLE_HISTORY_SYSTEM_V2), True, _USER_V2),
    "citation_history_v1": ("system", _flat(_CITATION_SYSTEM_V1), True, _CITATION_USER),
    "citation_history_v2": ("system", _flat(_CITATION_SYSTEM_V2), True, _CITATION_USER),
    "citation_history_v3": ("assistant", _flat(_CITATION_SYSTEM_V3), True, _CITATION_USER),
    "": ("human", None, False, "{context}"),
}
DEFAULT_TEMPLATE = "simple_history_v1"

MESSAGE = "struct<role:string,content:string>"


def resolve_template(name: str) -> str:
    """Unknown names fall back to simple_history_v1 (with a warning in the source; silent here)."""
    return name if name in TEMPLATES else DEFAULT_TEMPLATE


def fill(template: str, question: Column, context: Column) -> Column:
    """Fill ``{question}`` and ``{context}`` in one left-to-right pass over the template,
    so braces inside the filled values are never read as slots."""
    parts = []
    rest = template
    while rest:
        i_q, i_c = rest.find("{question}"), rest.find("{context}")
        cands = [(i, s) for i, s in ((i_q, "{question}"), (i_c, "{context}")) if i >= 0]
        if not cands:
            parts.append(F.lit(rest))
            break
        i, slot = min(cands)
        if i > 0:
            parts.append(F.lit(rest[:i]))
        parts.append(F.coalesce(question if slot == "{question}" else context, F.lit("")))
        rest = rest[i + len(slot):]
    return F.concat(*parts) if parts else F.lit("")


def message(role: str | Column, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def first_text(name: str, assistant: str = ASSISTANT) -> str | None:
    """The first message's text with the assistant's name put in."""
    text = TEMPLATES[resolve_template(name)][1]
    return None if text is None else text.replace("{assistant}", assistant)


def render_prompt(name: str, question: Column, context: Column, history: Column | None = None, assistant: str = ASSISTANT) -> Column:
    """A-03: ``array<struct<role,content>>`` for template ``name``.

    ``history`` is an ``array<struct<role,content>>`` (oldest first), used by
    the *_history_* templates; null/absent means no history.
    """
    role, _, with_history, human = TEMPLATES[resolve_template(name)]
    first = first_text(name, assistant)
    human_msg = F.array(message("human", fill(human, question, context)))
    if first is None:
        return human_msg
    head = F.array(message(role, F.lit(first)))
    if with_history and history is not None:
        hist = F.coalesce(history, F.array().cast(f"array<{MESSAGE}>"))
        return F.concat(head, hist, human_msg)
    return F.concat(head, human_msg)


def no_rag_prompt(name: str, question: Column) -> Column:
    """A-09: the same prompt with an empty context and no history (baseline answer)."""
    return render_prompt(name, question, F.lit(""), None)
