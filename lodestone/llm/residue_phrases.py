"""Phrases of pages and notices that stand where content should be.

STRONG phrases each mark an error, login, waiting or maintenance page, a demand for
scripts, an empty-page notice or filler text. SMALL and PAGE words beside them neither
cover a sentence nor count as its content. LATIN and MASH words are filler only in number.
All are lower-case, without accents being folded.
"""

STRONG = {
    "error": """
        access denied|permission denied|permission required|not allowed|forbidden|unauthorized|bad gateway|gateway time-out|gateway timeout
        service unavailable|internal server error|too many requests|not found|rate limit reached|slow down!|no healthy upstream|upstream connect error
        connection reset|disconnect before headers|before the response was complete|reset reason|unhandled exception|application error|server-side exception|could not render
        something went wrong|this should not have happened|that did not work|we hit a snag|an error occurred|an unexpected error|error while loading|nosuchkey|accessdenied|not_found
        cannot be shown|could not be found|cannot be found|is not available|has been deleted|has been removed|no longer exists|does not exist|could not be loaded|failed to load|does not work without
        this file is too large|request access|you cannot view this|you do not have access|you don't have permission|http 4|http 5|gone
        service_unavailable|internal_server_error|bad_gateway|too_many_requests|did not answer in time|quota exceeded|limit exceeded|slowdown|has been moved|moved or removed|timed out|request timeout|internal_error|rate_limited
        acesso negado|página não encontrada|pagina nao encontrada|não foi encontrada|não foi encontrado|ocorreu um erro|erro inesperado|erro interno|não está disponível|algo deu errado|não foi possível carregar
        acceso denegado|página no encontrada|no se pudo cargar|se produjo un error|ha ocurrido un error|error interno|que busca no existe|no está disponible|algo salió mal|no encontrada
        zugriff verweigert|seite nicht gefunden|nicht erreichbar|nicht gefunden|ein fehler ist aufgetreten|interner fehler|nicht verfügbar|etwas ist schiefgelaufen|seite existiert nicht|konnte nicht geladen werden
    """,
    "login": """
        sign in again|sign in to continue|sign-in required|log in to continue|login required|please log in|please sign in|you have been signed out|you must be logged in|session has expired|your session expired
        enter your password|forgot password|continue with single sign-on|stay signed in|remember me|create an account|sign in to your account|you need to sign in
        faça login|entre para continuar|sua sessão expirou|esqueceu a senha|inicie sesión|su sesión ha caducado|olvidó su contraseña|bitte melden sie sich an|anmeldung erforderlich|ihre sitzung ist abgelaufen|passwort vergessen
    """,
    "wait": """
        checking your browser|verifying that you are human|verify you are human|making sure that your connection|security check in progress|security check|this takes a few seconds|do not close this tab|just a moment|one moment, we are
        loading...|loading…|please wait|verificando o seu navegador|aguarde...|carregando...|comprobando su navegador|cargando...|espere un momento|ihr browser wird überprüft|wird geladen|bitte warten
        is taking a short break|down for maintenance|back soon|will be back shortly|be right back|under maintenance|scheduled maintenance|maintenance mode|under construction|check back later|expected end:
        em manutenção|voltamos em breve|em construção|en mantenimiento|volvemos pronto|en construcción|wartungsarbeiten|wartungsmodus|sind bald zurück|im aufbau
    """,
    "script": """
        enable javascript|enabling javascript|allow javascript|activate javascript|turn on javascript|need javascript|needs javascript|require javascript|requires javascript|needs to have javascript|javascript enabled|javascript must be
        enable scripts|allow scripts|activate scripts|turn on scripts|turn scripts on|scripts are needed|scripts and cookies|needs scripts|requires scripts|without scripts|without javascript|depends on scripts|depends on javascript|depends on client-side|scripts enabled|client-side scripts
        javascript has been|javascript is|javascript and cookies|scripts has been|scripts have been|scripts is|blocks scripts|javascript could not|seems to be blocked|is switched off|is disabled|has been disabled|have been disabled
        unsupported browser|browser is too old|browser is not supported|no longer supported by|your browser does not support|you need to allow|you need to enable|until you allow it|noscript
        precisa de javascript|habilite o javascript|ative o javascript|bloqueou os scripts|requer javascript|habilitar javascript|necesita javascript|active los scripts|active javascript|requiere javascript|habilite javascript|es necesario habilitar
        javascript aktivieren|benötigt skripte|benötigt javascript|skripte aktivieren|skripte zulassen|erfordert javascript|ohne skripte|ohne javascript
    """,
    "empty": """
        coming soon|content to follow|this section is still empty|page intentionally left blank|intentionally left blank|there isn't anything to show|nothing to show here|nothing here yet|nothing to see here|no content yet|this page is empty
        this repository is empty|this folder is empty|no description provided|no results to show|to be written|to be announced|próximamente|em breve|conteúdo em breve|nada por aqui|esta página está vazia|todavía no hay|aún no hay|contenido en breve
        demnächst|folgt in kürze|inhalt folgt|noch keine inhalte|hier gibt es noch nichts|diese seite ist leer|esta seção está vazia|esta sección está vacía|no content to display
    """,
    "filler": """
        lorem ipsum|dummy paragraph|dummy text|placeholder text|sample text|example copy|filler text|your description goes here|your text here|your content here|add your content|text goes here|goes here
        replace this paragraph|replace this text|you can change this text|this is a default page|edit it to tell readers|write two or three sentences|delete this hint|delete this line when|describe your|write something about
        texto de exemplo|texto de relleno|texto de ejemplo|texto de preenchimento|substitua este parágrafo|escreva aqui|apague este aviso|cambie este párrafo|sustituya este párrafo|escriba aquí|borre este aviso|insira o texto|inserte el texto
        blindtext|fülltext|platzhaltertext|beispieltext|durch eigenen inhalt ersetzen|ersetzen sie diesen|schreiben sie hier|hier steht|hier entsteht
    """,
}

# Words that say nothing of what a sentence is about: articles, prepositions, pronouns and auxiliary verbs.
SMALL = """
    a an the this that these those it its is are was were be been being am has have had do does did can could cannot will would may might must should shall to of in on at for from with by as or and but if then than not no yes you your yours we our us i me my he she they them their there here what which who when where while why how again later now so up out off over back into about under between any some all more please just only too also very
    o os um uma e ou de do da dos das em no na nos nas por para com sem que se não é são foi está esta este isto seu sua você ao à mais já tente
    el la los las un unos unas y en del al por con sin lo su sus es son está están fue ha este esta esto se si no que más vuelva a para le
    der die das ein eine einen einer eines dem den des und oder in im an am auf aus bei mit nach von vor zu zum zur für über ist sind war wird werden hat nicht kein keine sie ihr ihre wir uns um es noch bitte
"""  # fmt: skip

# Words of pages, programs and files in general: what a notice speaks of, whatever it says.
PAGE = """
    page pages site website web app application browser server client file files folder document documents documentation docs content text link links address url path resource request requests response message messages status code codes error errors detail details trace id reference digest version upstream host network connection gateway edge cache log logs
    home menu start help centre center contact support team account user owner group access settings extension plugin cookies cookie javascript script scripts view viewer explorer editor code build
    package module project section paragraph title description summary template readers reader
    minute minutes second seconds moment time day reload refresh retry try go return open read run show see view load loading render rendering sign log wait thank patience sorry oops whoops hmm true false ok null
    página pagina arquivo documento conteúdo conteudo erro servidor navegador visualizador recurso módulo pacote descrição parágrafo aviso início contenido archivo referencia paquete módulo descripción párrafo navegador inicio recargue solicitada
    seite inhalt inhalts fehler vorgang ansicht angeforderte später erneut versuchen datei dokument paket modul anzuzeigen zurzeit
"""  # fmt: skip

LATIN = """
    lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation
    ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat
    non proident sunt culpa officia deserunt mollit anim est laborum vivamus turpis lectus massa orci porta sapien felis risus nunc pellentesque mauris vestibulum
"""  # fmt: skip

MASH = "asdf asdfgh qwer qwerty sdfg zxcv foo bar baz blah test xxx xxxx yyyy hjkl jkl abc aaaa"

# Slots of templates that nobody filled, and values that were rendered badly.
SLOTS = (
    r"\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|#\{[^{}\n]+\}|<%=?[^%\n]+%>|<<[A-Za-z][\w .-]*>>|\[\[[A-Za-z][\w .-]*\]\]"
    r"|(?<![\w$#{%]){[a-z][a-z_]+}(?![\w}])|%[A-Z][A-Z0-9_]+%|(?<![\w$])\$[A-Z][A-Z0-9_]+\$|(?<![\w])__[A-Z][A-Z0-9_]*?__(?![\w])|@@[A-Z][A-Z0-9_]+@@"
    r"|\[(?:insert|your|enter|add|todo:?|tbd:?|inserir|insertar|einfügen)\b[^\]\n]*\]|\[[A-Z][A-Z ]*(?:NAME|DATE|TITLE|HERE|EMAIL|URL)\]|<(?:insert|your)[ _-][A-Za-z][^<>\n]*>"
    r"|\[object Object\]|\bInvalid Date\b|\b(?:by|since|of|version|from|for|hello|hi|dear|von|por|de|desde|am|on)\s+(?:undefined|null|NaN)\b|\b(?:undefined|NaN)\s+(?:of|by|since|undefined|NaN|null)\b"
)
