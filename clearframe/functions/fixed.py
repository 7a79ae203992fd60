"""Effect names, call tables and phrases that results must agree on."""

#: Effects in canonical order.
EFFECTS = ("network", "db_read", "db_write", "fs_read", "fs_write", "state_write", "llm", "env", "process")

#: Module specifiers that are also written with the prefix ``node:``.
PREFIXABLE = ("child_process", "fs", "fs/promises", "http", "https", "net", "tls", "worker_threads")

#: Calls with one known effect, by module: effect -> names.
STUBS = {
    "": {"network": "fetch globalThis.fetch undici.fetch ky.default ky.get ky.post ky.put ky.patch ky.delete ky.head"},
    "node:http.": {"network": "request get"},
    "node:https.": {"network": "request get"},
    "node:net.": {"network": "connect createConnection"},
    "node:fs.": {
        "fs_read": "readFile readdir readdirSync realpath realpathSync stat lstat lstatSync access accessSync readFileSync existsSync statSync",
        "fs_write": "writeFile writeFileSync appendFile appendFileSync mkdir mkdirSync mkdtemp mkdtempSync rm rmSync unlink unlinkSync",
    },
    "node:fs/promises.": {"fs_read": "readFile readdir realpath stat lstat access", "fs_write": "writeFile appendFile mkdir mkdtemp rm unlink"},
    "node:child_process.": {"process": "exec execSync execFile spawn spawnSync fork"},
}

#: Builtins with an effect.
BUILTIN_STUBS = {"DateConstructor.now": "env", "Math.random": "env"}

#: Methods whose first argument is an SQL statement.
SQL_METHODS = (
    "pg.Pool.query pg.Client.query pg.PoolClient.query mysql2.Pool.query mysql2.Pool.execute mysql2.Connection.query mysql2.Connection.execute "
    "mysql2/promise.Pool.query mysql2/promise.Pool.execute mysql2/promise.Connection.query mysql2/promise.Connection.execute"
).split()

#: Client methods by pattern (``*`` is one segment): prefix -> effect -> names.  First match wins.
CLIENTS = {
    "knex.QueryBuilder.": {"db_read": "select from first pluck count", "db_write": "insert update del delete truncate"},
    "@prisma/client.PrismaClient.*.": {
        "db_read": "findMany findFirst findFirstOrThrow findUnique findUniqueOrThrow count aggregate groupBy",
        "db_write": "create createMany update updateMany upsert delete deleteMany",
    },
    "@prisma/client.PrismaClient.": {"db_read": "$queryRaw $queryRawUnsafe", "db_write": "$executeRaw $executeRawUnsafe", "db_read,db_write": "$transaction"},
    "openai.OpenAI.": {"llm": "chat.completions.create responses.create embeddings.create"},
    "openai.default.": {"llm": "chat.completions.create responses.create embeddings.create"},
    "@anthropic-ai/sdk.Anthropic.": {"llm": "messages.create"},
    "@anthropic-ai/sdk.default.": {"llm": "messages.create"},
}

#: Statement keywords that read and that write.
SQL_READ = ("select", "show", "explain", "describe")
SQL_WRITE = ("insert", "update", "delete", "replace", "merge", "upsert", "create", "drop", "alter", "truncate", "grant", "revoke")

#: Path arguments that file operations read and write, by position.
FS_RULES = {
    **{name: {"read": (0,)} for name in "readFile readdir access stat lstat realpath readlink".split()},
    **{name: {"write": (0,)} for name in "writeFile appendFile mkdir rmdir rm unlink truncate chmod".split()},
    "symlink": {"write": (1,)},
    **{name: {"read": (0,), "write": (1,)} for name in "rename copyFile link".split()},
}

#: Calls with an http target: name -> (default action, whether an options argument names the method).
HTTP = {
    "fetch": ("get", True), "globalThis.fetch": ("get", True), "undici.fetch": ("get", True), "node:http.get": ("get", False), "node:https.get": ("get", False),
    "node:http.request": ("get", True), "node:https.request": ("get", True), "ky.default": ("get", True), "ky.get": ("get", False), "ky.post": ("post", False),
    "ky.put": ("put", False), "ky.patch": ("patch", False), "ky.delete": ("delete", False), "ky.head": ("head", False),
}

#: Constructions with an effect, with one only when they have no arguments, and without any.
CONSTRUCTORS = {"new node:net.Socket": "network", "new node:tls.TLSSocket": "network", "new node:http.Agent": "network", "new node:https.Agent": "network", "new WebSocket": "network", "new node:worker_threads.Worker": "process"}
NULLARY_CONSTRUCTORS = {"new Date": "env"}
PURE_CONSTRUCTORS = (
    "Map Set WeakMap WeakSet Array Object Promise RegExp Error TypeError RangeError SyntaxError EvalError ReferenceError AggregateError URL URLSearchParams Headers Request Response FormData "
    "TextEncoder TextDecoder AbortController Number String Boolean Int8Array Uint8Array Uint8ClampedArray Int16Array Uint16Array Int32Array Uint32Array Float32Array Float64Array BigInt64Array "
    "BigUint64Array ArrayBuffer DataView"
).split()
HIGHER_ORDER_CONSTRUCTORS = ("new Promise",)


def stub_rows() -> list[tuple[str, str]]:
    return [(module + name, effect) for module, by in STUBS.items() for effect, names in by.items() for name in names.split()]


def client_rows() -> list[tuple[int, str, str]]:
    rows = [(prefix + name, effect) for prefix, by in CLIENTS.items() for effect, names in by.items() for name in names.split()]
    return [(i, pattern, effect) for i, (pattern, effect) in enumerate(rows)]
