"""Frameworks that call code by themselves: patterns of roots and of dynamic behaviour, by language.

The registry is a plain tuple; callers may pass their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.rules import holds


@dataclass(frozen=True)
class Framework:
    name: str
    language: str
    roots: tuple[str, ...] = ()
    decorators: tuple[str, ...] = ()
    annotations: tuple[str, ...] = ()
    registrations: tuple[str, ...] = ()
    generated: tuple[str, ...] = ()
    dynamic: tuple[str, ...] = ()


# What shows that a framework of a language is at work.
FRAMEWORKS = (
    Framework("rust_stdlib", "rust", ("fn main()", "#[tokio::main]", "#[async_std::main]", "#[actix_web::main]"), ("#[derive", "#[serde", "#[wasm_bindgen"), (), ("#[no_mangle]", "#[export_name", "#[link_name"), ("build.rs",), ("Box<dyn", "&dyn", 'extern "C"', "fn pointer")),
    Framework("yew", "rust", ("#[function_component]",), ("#[function_component]",), (), ("yew::start_app", "yew::Renderer"), (), ("html!", "Callback::from")),
    Framework("tauri", "rust", ("fn main()", "tauri::Builder", "tauri::generate_context"), ("#[tauri::command]",), (), ("invoke_handler", "tauri::generate_handler", ".run(", "expect"), ("tauri.conf.json", "src-tauri/"), ("invoke", "emit", "listen", "window", "webview")),
    Framework("flask", "python", ("@app.route", "@app.get", "@app.post"), ("@app.route", "@app.before_request", "@app.teardown_request", "@app.errorhandler"), (), ("app.register_blueprint",), (), ("url_for", "getattr", "__import__")),
    Framework("django", "python", ("def view", "class View", "class APIView"), ("@login_required", "@permission_required"), (), ("urlpatterns", "path(", "re_path("), ("manage.py",), ("getattr", "import_module")),
    Framework("fastapi", "python", ("@app.get", "@app.post", "@app.put", "@app.delete", "@app.patch"), ("@app.middleware", "@app.on_event"), (), ("APIRouter", "include_router"), (), ("Depends", "BackgroundTasks")),
    Framework("react", "javascript", ("export default function", "export function", "export const"), ("@connect", "@withRouter"), (), ("ReactDOM.render", "createRoot", "hydrateRoot"), (), ("useEffect", "useCallback", "React.lazy", "import(")),
    Framework("express", "javascript", ("app.get", "app.post", "app.put", "app.delete", "app.use"), (), (), ("express()", "app.listen", "router.get"), (), ("require", "import(", "eval")),
    Framework("nextjs", "javascript", ("export default", "export async function"), (), (), ("getServerSideProps", "getStaticProps", "getStaticPaths"), ("pages/", "app/"), ("dynamic(", "import(")),
    Framework("angular", "typescript", ("export class",), ("@Component", "@Directive", "@Pipe", "@Injectable", "@NgModule"), (), ("bootstrapModule", "platformBrowserDynamic"), ("main.ts",), ("inject(", "new InjectionToken")),
    Framework("nestjs", "typescript", ("export class",), ("@Controller", "@Module", "@Injectable", "@Get", "@Post", "@Put", "@Delete"), (), ("NestFactory.create", "@Inject"), ("main.ts",), ("@Inject", "forwardRef")),
    Framework(
        "react", "typescript", ("export default function", "export function", "export const", "export default class"), ("@connect", "@withRouter", "@observer"), (), ("ReactDOM.render", "createRoot", "hydrateRoot", "ReactDOM.createRoot"), ("pages/", "app/"),
        ("useEffect", "useCallback", "useMemo", "useState", "useRef", "React.lazy", "import(", "forwardRef", "memo"),
    ),
    Framework("go_stdlib", "go", ("func main()", "func init()"), (), (), ("http.HandleFunc", "http.ListenAndServe", "rpc.Register"), ("cmd/",), ("go func", "reflect", "interface{}")),
    Framework("gin", "go", ("func main()",), (), (), ("gin.Default", "gin.New", "router.GET", "router.POST"), (), ("c.ShouldBind", "c.Param")),
    Framework("spring", "java", ("public static void main",), (), ("@Controller", "@RestController", "@Service", "@Component", "@Repository", "@Configuration"), ("@Bean", "@Autowired", "@Value"), (), ("@Transactional", "@Async", "ApplicationContext", "Class.forName")),
    Framework("android", "java", ("onCreate", "onStart", "onResume"), (), ("@Override", "@SuppressLint"), ("setContentView", "startActivity"), ("R.layout", "AndroidManifest.xml"), ("findViewById", "Intent", "BroadcastReceiver")),
    Framework("flutter", "dart", ("void main()", "Future<void> main"), ("@override", "@protected"), ("@override", "@required"), ("runApp", "MaterialApp", "CupertinoApp"), ("lib/main.dart",), ("Navigator.push", "showDialog", "setState")),
    Framework("laravel", "php", ("function __construct", "function handle"), ("@middleware",), ("@Route", "@Middleware"), ("Route::get", "Route::post", "Route::resource", "Artisan::command"), ("routes/web.php", "routes/api.php"), ("app(", "resolve", "event(")),
    Framework("symfony", "php", ("function __invoke", "function execute"), (), ("@Route", "@Security"), ("services.yaml", "autowire", "autoconfigure"), ("public/index.php",), ("container->get", "EventDispatcher")),
    Framework("cpp_stdlib", "cpp", ("int main", "void main", "wmain", "WinMain"), (), (), ('extern "C"', "__declspec(dllexport)", "JNIEXPORT"), ("CMakeLists.txt",), ("virtual", "std::function", "dlopen", "dlsym")),
    Framework("qt", "cpp", ("int main",), (), ("Q_OBJECT", "Q_INVOKABLE", "signals:", "slots:"), ("QApplication", "qmlRegisterType", "QObject::connect"), ("moc_",), ("QMetaObject", "invokeMethod", "Q_EMIT")),
    Framework("aspnet", "csharp", ("static void Main", "static async Task Main"), ("[ApiController]", "[Route", "[HttpPost", "[HttpGet"), ("[ApiController]", "[Route"), ("app.MapController", "app.MapGet", "app.MapPost", "builder.Services.Add"), ("Program.cs", "Startup.cs"), ("reflection", "Activator.CreateInstance", "dynamic")),
    Framework("unity", "csharp", ("void Awake", "void Start", "void Update", "void FixedUpdate"), (), ("[SerializeField]", "[RequireComponent]"), ("gameObject.AddComponent", "Instantiate"), ("Assets/",), ("GetComponent", "SendMessage", "Invoke")),
)
# Names of methods that frameworks call back.
CALLBACKS = (
    "_subscribe _unsubscribe _dispose _close _report _checkForUpdates _analyzeContent _analyzeFile _merge _fromJson _toJson _cast _startListening _updateLatestValue _maybeStreamIdentical _buildGenerator _vars _getLineOffsets "
    "_computeLineOffsets _ensureBeforeEndOfLine _lineIgnores _ignoresAboveLine _ignoresAfterLine _isEndOfLine _getTokens _getFieldName _getReturnType _traverseRead _traverseWrite _traverseJson _traverseAtomicJson "
    "_traverseComplexJson _removeSeen _checkCycle _toEncodable _observer _reportDiagnostics _analyzeDirectory"
).split()


def _shown(language: Column, text: Column, patterns: dict[str, set[str]]) -> Column:
    """Whether the text holds a pattern of the language; a null text holds none."""
    out = F.lit(False)
    for of, parts in patterns.items():
        if parts:
            out = out | ((language == of) & holds(text, *sorted(parts)))
    return F.coalesce(out, F.lit(False))


def _patterns(frameworks: tuple[Framework, ...], *lists: str) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for f in frameworks:
        out.setdefault(f.language, set()).update(p for kind in lists for p in getattr(f, kind))
    return out


def is_root(language: Column, source: Column, name: Column, frameworks: tuple[Framework, ...] = FRAMEWORKS) -> Column:
    """Whether a framework of the language shows in a text (a path or a source), or a generated entry point in the name."""
    return _shown(language, source, _patterns(frameworks, "roots", "decorators", "annotations", "registrations")) | _shown(language, name, _patterns(frameworks, "generated"))


def is_marked(language: Column, decorators: Column, frameworks: tuple[Framework, ...] = FRAMEWORKS) -> Column:
    """Whether decorators (a text) are those of a root; annotations, which plain overrides carry too, don't count."""
    return _shown(language, decorators, _patterns(frameworks, "roots", "decorators"))


def is_dynamic(language: Column, source: Column, frameworks: tuple[Framework, ...] = FRAMEWORKS) -> Column:
    """Whether a source registers or creates things by name."""
    return _shown(language, source, _patterns(frameworks, "dynamic"))


def is_callback(name: Column) -> Column:
    return name.isin(*CALLBACKS)
