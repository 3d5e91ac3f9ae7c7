"""Vocabularies, rule tables and limits.

Every value here is a fixed value: results depend on it word for word, so it is
stated as plain text and kept in one place.
"""

from __future__ import annotations

# --- Fixed values: words never counted as keywords -------------------------
STOPWORDS = """
a an the and or but if then else for to of in on at by with from as is are was
were be been being this that these those it its we you your they their our us
he she his her them i me my who whom which what will would can could should
shall may might must have has had do does did not no so than too very just
about into over under up down out off again further all any both each few more
most other some such only own same per etc please
job role responsibilities responsible requirements required preferred
qualifications candidate candidates company years year including using based
within across ability abilities strong excellent experience experienced work
working team teams e.g eg looking plus you'll we're join help make new also
well good
bachelor bachelors master masters degree diploma equivalent employer employment
employees employee compensation salary benefits insurance equal opportunity
disability veteran race gender religion apply application applicants resume
cover letter office onsite remote hybrid travel location position positions
full-time part-time contract hire hiring growing fast-paced environment culture
mission vision values diverse inclusion inclusive world global industry
background passion passionate self-starter motivated detail-oriented fast paced
note eeo aa aap knowledge need needed needs familiarity familiar understanding
solid deep proven demonstrated hands-on hand
title titled skill skills field fields related conduct conducted drive driven
driving professional professionally dynamic cutting-edge state-of-the-art tool
tools methodology methodologies fast-growing fastgrowing similar similarly
""".split()

# --- Fixed values: word families, "root: members" --------------------------
WORD_FAMILY_LINES = """
collaborat: collaboration collaborate collaborated collaborating collaborative collaborator collaborators
optimiz: optimization optimizations optimize optimized optimizing optimal optimally
automat: automation automate automated automating automatic automatically
mentor: mentorship mentor mentored mentoring mentors
document: documentation document documented documenting documents
communicat: communication communicate communicated communicating communications
implement: implementation implement implemented implementing implementations
integrat: integration integrate integrated integrating integrations
migrat: migration migrate migrated migrating migrations
configur: configuration configure configured configuring configurations
administ: administration administer administered administering administrator administrators
architect: architecture architect architected architecting architectures architects
certif: certification certify certified certifying certifications certificate certificates
lead: leadership lead led leading leader leaders
manag: management manage managed managing manager managers
develop: development develop developed developing developer developers
deploy: deployment deploy deployed deploying deployments
monitor: monitoring monitor monitored monitors
scal: scaling scale scaled scalable scales scalability
analy: analysis analyze analyzed analyzing analytics analytical analyst analysts
evaluat: evaluation evaluate evaluated evaluating evaluations
coordinat: coordination coordinate coordinated coordinating
execut: execution execute executed executing
deliver: delivery deliver delivered delivering deliverables
own: ownership own owned owning owner owners
secur: security secure secured securing
perform: performance perform performed performing
innovat: innovation innovate innovated innovating innovative
methodolog: methodology methodologies
technolog: technology technologies
respons: responsibility responsibilities responsible
improv: improve improves improved improving improvement improvements
creat: create creates created creating creation creations
generat: generate generates generated generating generation
reduc: reduce reduces reduced reducing reduction reductions
increas: increase increases increased increasing
produc: produce produces produced producing production
provid: provide provides provided providing provider providers
driv: drive drives drove driven driving
writ: write writes writing wrote written
"""


def _families(*blocks: str) -> dict[str, str]:
    pairs = {}
    for line in "".join(blocks).strip().splitlines():
        if line:
            root, _, members = line.partition(":")
            pairs.update(dict.fromkeys(members.split(), root))
    return pairs


WORD_FAMILIES = _families(WORD_FAMILY_LINES)


def _terms(text: str) -> list[str]:
    return [t.strip() for t in text.replace("\n", ",").split(",") if t.strip()]


# --- Fixed values: skill vocabularies by category ---------------------------
CATEGORIES: dict[str, list[str]] = {
    "programming_languages": _terms("""
        python, javascript, typescript, java, kotlin, swift, go, golang, rust,
        php, ruby, scala, c++, c#, c, perl, r, dart, objective-c, elixir,
        haskell, clojure, matlab"""),
    "frameworks": _terms("""
        react, angular, vue, nextjs, nuxt, django, flask, fastapi, spring,
        express, rails, laravel, nestjs, svelte, dotnet, .net, asp.net, ember,
        backbone, gatsby, remix"""),
    "cloud_platforms": _terms("""
        aws, azure, gcp, google cloud, heroku, digitalocean, cloudflare, vercel,
        netlify, oracle cloud, ibm cloud, alibaba cloud"""),
    "databases": _terms("""
        postgresql, postgres, mysql, mongodb, redis, elasticsearch, dynamodb,
        sql, nosql, cassandra, oracle, mariadb, sqlite, snowflake, bigquery,
        redshift, databricks, firestore, couchbase, neo4j"""),
    "devops_tools": _terms("""
        docker, kubernetes, terraform, ansible, jenkins, gitlab, github actions,
        circleci, puppet, chef, helm, argo cd, prometheus, grafana, datadog,
        splunk, istio, ecs, eks, cloudformation, pulumi"""),
    "ai_ml_tools": _terms("""
        tensorflow, pytorch, scikit-learn, keras, pandas, numpy, huggingface,
        langchain, openai, llm, llms, nlp, machine learning, deep learning,
        mlops, generative ai, computer vision, spark, hadoop, airflow"""),
    "methodologies": _terms("""
        agile, scrum, kanban, waterfall, safe, lean, tdd, bdd, devops, ci/cd,
        pair programming, trunk-based development, extreme programming,
        sprint planning, code review"""),
    "soft_skills": _terms("""
        communication, leadership, collaboration, mentoring, mentorship,
        stakeholder management, problem-solving, problem solving, ownership,
        cross-functional, teamwork, adaptability, time management,
        critical thinking, attention to detail, customer-focused, self-starter"""),
}
EXTRA_TECHNOLOGIES = _terms("""
    kafka, rabbitmq, graphql, grpc, microservices, git, linux, bash, html, css,
    sass, tailwind, jira, figma""")
FRONTEND_FRAMEWORKS = _terms("""
    react, angular, vue, nextjs, nuxt, svelte, ember, backbone, gatsby, remix""")
TECHNOLOGY_CATEGORIES = (
    "programming_languages", "frameworks", "cloud_platforms", "databases",
    "devops_tools", "ai_ml_tools",
)
MATCH_CATEGORIES = TECHNOLOGY_CATEGORIES + ("methodologies",)
TECHNOLOGIES = sorted(
    {t for c in TECHNOLOGY_CATEGORIES for t in CATEGORIES[c]} | set(EXTRA_TECHNOLOGIES)
)

# Acronyms shown in capitals.
ACRONYMS = _terms("""
    ci/cd, api, apis, sql, nosql, aws, gcp, sso, jwt, rest, grpc, saas, paas,
    iaas, ui, ux, css, html, xml, json, yaml, sdk, cli, orm, crud, tdd, bdd,
    oop, mvc, seo, ai, ml, nlp, llm, etl, vpc, iam, cdn, dns, http, https""")

# Preferred-line tokens that are not skills.
PREFERRED_NOISE = _terms("""
    api, apis, caching, experience, experiences, applications, services,
    systems, tools, software, development, knowledge, ability, strong, years,
    plus, bonus, preferred, nice, have, good, working, using, etc, including,
    related""")

# Business-domain cue -> label, first hit wins.
DOMAIN_CUES = [
    ("fintech", "Fintech"), ("financial services", "Fintech"), ("banking", "Banking"),
    ("healthcare", "Healthcare"), ("health tech", "Healthcare"), ("healthtech", "Healthcare"),
    ("e-commerce", "E-commerce"), ("ecommerce", "E-commerce"), ("retail", "Retail"),
    ("saas", "SaaS"), ("logistics", "Logistics"), ("supply chain", "Logistics"),
    ("gaming", "Gaming"), ("insurance", "Insurance"), ("insurtech", "Insurance"),
    ("edtech", "Education"), ("education", "Education"), ("cybersecurity", "Cybersecurity"),
    ("telecom", "Telecom"), ("telecommunications", "Telecom"), ("travel", "Travel"),
    ("hospitality", "Travel"), ("real estate", "Real Estate"), ("proptech", "Real Estate"),
    ("media", "Media"), ("entertainment", "Media"), ("advertising", "AdTech"),
    ("adtech", "AdTech"), ("biotech", "Biotech"), ("pharma", "Biotech"),
    ("manufacturing", "Manufacturing"), ("energy", "Energy"), ("automotive", "Automotive"),
    ("government", "Government/Public Sector"), ("nonprofit", "Nonprofit"),
]

# --- Fixed values: transferable-skill families, tier by tier ----------------
SKILL_FAMILIES: list[list[list[str]]] = [
    [
        _terms("aws, azure, gcp, cloud"),
        _terms("mysql, postgresql, postgres, mssql, oracle, sqlite, mariadb, sql"),
        _terms("mongodb, dynamodb, cassandra, couchbase, firestore, nosql"),
        _terms("kafka, rabbitmq, sqs, activemq, pubsub"),
        _terms("docker, kubernetes, containerd, podman"),
        _terms("react, vue, angular, svelte"),
        _terms("django, flask, fastapi, express, spring, rails"),
        _terms("jenkins, gitlab, circleci, github, travis"),
        _terms("terraform, ansible, puppet, chef, cloudformation"),
    ],
    [
        _terms("aws, azure, gcp, cloud, lambda, ec2, s3, heroku, vercel, netlify, digitalocean"),
        _terms("mysql, postgresql, postgres, mssql, oracle, sqlite, mariadb, sql, "
               "snowflake, bigquery, redshift, databricks"),
        _terms("mongodb, dynamodb, cassandra, couchbase, firestore, nosql, redis"),
        _terms("kafka, rabbitmq, sqs, sns, activemq, pubsub, eventbridge"),
        _terms("docker, kubernetes, containerd, podman, helm, ecs, eks, openshift"),
        _terms("react, vue, angular, svelte, nextjs, nuxt, ember"),
        _terms("django, flask, fastapi, express, spring, rails, laravel, nestjs"),
        _terms("jenkins, gitlab, circleci, github, travis, teamcity, bamboo, argo, actions"),
        _terms("terraform, ansible, puppet, chef, cloudformation, pulumi"),
        _terms("agile, scrum, kanban, waterfall, safe"),
        _terms("junit, pytest, selenium, cypress, jest, mocha, testng"),
        _terms("tableau, powerbi, looker, grafana, kibana, datadog, splunk"),
        _terms("graphql, grpc, rest, soap, websocket"),
    ],
    [
        _terms("aws, azure, gcp, cloud, lambda, ec2, ecs, eks, fargate, s3, heroku, vercel, "
               "netlify, digitalocean, serverless, cloud functions, azure functions, "
               "kubernetes, docker, containerd, podman, openshift"),
        _terms("mysql, postgresql, postgres, mssql, oracle, sqlite, mariadb, sql, nosql, "
               "snowflake, bigquery, redshift, databricks, mongodb, dynamodb, cassandra, "
               "couchbase, firestore, redis"),
        _terms("kafka, rabbitmq, sqs, sns, activemq, pubsub, eventbridge, kinesis, nats, "
               "event-driven, message queue, messaging"),
        _terms("terraform, ansible, puppet, chef, cloudformation, pulumi, ci/cd, jenkins, "
               "gitlab, circleci, github actions, automation, infrastructure as code, devops"),
        _terms("react, vue, angular, svelte, nextjs, nuxt, ember, frontend"),
        _terms("django, flask, fastapi, express, spring, rails, laravel, nestjs, node.js, "
               "nodejs, backend"),
        _terms("agile, scrum, kanban, waterfall, safe, methodology"),
        _terms("junit, pytest, selenium, cypress, jest, mocha, testng, testing"),
        _terms("tableau, powerbi, looker, grafana, kibana, datadog, splunk, monitoring, "
               "observability"),
        _terms("graphql, grpc, rest, soap, websocket, api"),
        _terms("tensorflow, pytorch, scikit-learn, keras, machine learning, ai, llm, nlp"),
    ],
]
MODE_TIERS = {"accurate": 1, "aggressive": 2, "aggressive_match": 3}

# --- Fixed values: introduction month of each technology --------------------
TECH_INTRODUCED = {
    "mcp": "2024-11-01",
    "model context protocol": "2024-11-01",
    "chatgpt": "2022-11-01",
    "gpt-4": "2023-03-01",
    "gpt4": "2023-03-01",
    "claude": "2023-03-01",
    "langchain": "2022-10-01",
    "llamaindex": "2022-11-01",
    "openai api": "2020-06-01",
    "github copilot": "2021-06-01",
}

# Era-neutral wording, (alias, pattern, replacement), in order.
ERA_SUBSTITUTIONS = [
    ("mcp", r"(?i)\bMCP[- ]compliant\b", "enterprise"),
    ("mcp", r"(?i)\bMCP servers?\b", "platform services"),
    ("mcp", r"(?i)\bMCP artifacts?\b", "platform artifacts"),
    ("mcp", r"(?i)\bMCP (?:server )?governance\b", "platform governance"),
    ("mcp", r"(?i)\bMCP registry\b", "enterprise registry"),
    ("mcp", r"(?i)\bMCP (?:metadata|entries|deployments|concepts|onboarding|integrations?)\b",
     "platform tooling"),
    ("mcp", r"(?i)\bModel Context Protocol\b", "platform integration standards"),
    ("mcp", r"(?i)\bMCP\b", "platform tooling"),
    ("chatgpt", r"(?i)\bChatGPT\b", "AI assistants"),
    ("gpt-4", r"(?i)\bGPT-4\b", "large language models"),
    ("gpt4", r"(?i)\bGPT-?4\b", "large language models"),
    ("claude", r"(?i)\bClaude\b", "AI assistants"),
    ("langchain", r"(?i)\bLangChain\b", "AI orchestration tooling"),
    ("llamaindex", r"(?i)\bLlamaIndex\b", "AI retrieval tooling"),
    ("openai api", r"(?i)\bOpenAI API\b", "ML APIs"),
    ("github copilot", r"(?i)\bGitHub Copilot\b", "developer tooling"),
]
ERA_FALLBACK = "platform tooling"

# --- Fixed values: primary-stack families and their markers -----------------
STACK_FAMILIES: dict[str, list[str]] = {
    "dotnet": _terms(".net, dotnet, c#, csharp, asp.net, aspnet, f#"),
    "php": _terms("php, laravel, symfony, wordpress, magento, phpunit"),
    "java": _terms("java, spring, spring boot, kotlin, hibernate, maven, gradle"),
    "nodejs": _terms("node.js, nodejs, node, express, nestjs, typescript backend"),
    "python": _terms("python, django, flask, fastapi, pytest"),
    "golang": _terms("golang, go lang"),
    "ruby": _terms("ruby, rails, ror"),
    "scala": _terms("scala, akka, play framework"),
    "rust": _terms("rust, actix, axum"),
}
# Wording used when moving text onto a primary stack.
_MICROSOFT_STACK = r"(?i)\bC#|\.NET\b|ASP\.NET(?: Core)?\b"
STACK_REWRITES: dict[str, list[tuple[str, str]]] = {
    "dotnet": [
        (r"(?i)\bPHPUnit\b", "xUnit"),
        (r"(?i)\bLaravel\b", "ASP.NET Core"),
        (r"(?i)\bSymfony\b", "ASP.NET Core"),
        (r"(?i)\bWordPress\b", ".NET CMS integrations"),
        (r"(?i)\bMagento\b", ".NET e-commerce services"),
        (r"(?i)\bPHP\b", "C#/.NET"),
    ],
    "java": [
        (r"(?i)\bPHPUnit\b", "JUnit"),
        (r"(?i)\bLaravel\b", "Spring Boot"),
        (r"(?i)\bSymfony\b", "Spring Boot"),
        (r"(?i)\bPHP\b", "Java"),
        (_MICROSOFT_STACK, "Java/Spring"),
    ],
    "nodejs": [
        (r"(?i)\bPHPUnit\b", "Jest"),
        (r"(?i)\bLaravel\b", "NestJS"),
        (r"(?i)\bPHP\b", "Node.js"),
        (_MICROSOFT_STACK, "Node.js"),
    ],
    "python": [
        (r"(?i)\bPHPUnit\b", "pytest"),
        (r"(?i)\bLaravel\b", "Django"),
        (r"(?i)\bPHP\b", "Python"),
        (_MICROSOFT_STACK, "Python"),
    ],
}

# --- Fixed values: stage names in report order, with target seconds ---------
STAGE_TARGETS = {
    "CV Parsing": 1.0,
    "JD Analysis": 0.5,
    "Resume Matching": 0.3,
    "Prompt Build": 0.2,
    "OpenAI": 60.0,
    "Validation": 0.3,
    "Cover Letter": 90.0,
    "Application Answers": 90.0,
    "PDF Generation": 1.0,
    "DOCX Generation": 1.5,
    "Response": 0.1,
}

# --- Fixed values: section headings of a profile ----------------------------
SECTION_HEADINGS: dict[str, list[str]] = {
    "summary": _terms("""summary, professional summary, profile, professional profile,
        objective, career objective, about, about me, overview"""),
    "skills": _terms("""skill, skills, technical skills, core competencies, competencies,
        technologies, skills & tools, skills and tools, key skills,
        skills & abilities, skills and abilities"""),
    "experience": _terms("""experience, work experience, employment, employment history,
        professional experience, work history, career history, relevant experience,
        professional background, career, employment record, experience & education,
        experience and education, professional history"""),
    "education": _terms("education, academic background, academic history, qualifications"),
    "languages": _terms("languages, language proficiency, language skills, spoken languages"),
    "certifications": _terms("""certifications, certificates, licenses & certifications,
        licenses and certifications, certifications & licenses, credentials"""),
}

# --- Fixed values: skill groups of a tailored profile ------------------------
SKILL_GROUPS = {
    "languages": "Languages", "backend": "Backend", "frontend": "Frontend", "cloud": "Cloud",
    "devops": "DevOps", "databases": "Databases", "ai": "AI", "tools": "Tools",
}

# --- Fixed values: limits that callers may pass; nothing applies them by default ---
MAX_PER_CATEGORY = 12
MAX_PREFERRED = 20
MAX_QUESTIONS = 12
SKILL_DIGEST_LIMIT = 18
BULLETS_PER_JOB = 8
COMPETING_ALLOWANCE = 2
WOVEN_TERMS = 8
MAX_LINK_LENGTH = 2000
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
UPLOAD_EXTENSIONS = ["pdf", "doc", "docx"]
"""Extensions accepted at upload; ``doc`` passes here and fails later at extraction."""
