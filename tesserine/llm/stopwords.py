"""Function words by language. Ordinary stop words, as any dictionary lists them."""

FUNCTION_WORDS = {
    "en": "a about after all an and any are as at be because been before but by can could do does each every for from had has have he how if in into is it its may more must never no not of on once one only or our over same should since so some than that the their them then there they this to two until up was we were what when where which while who will with within without would yet you your",
    "de": "aber alle als am an auch auf aus bei bevor bis das dass dem den denn der des die dies diese dieser dieses doch durch ein eine einem einen einer eines er es für hat haben ich ihr im in ist jede jeden jeder jedes kann kein keine man mit nach nicht noch nur ob oder ohne sein seine sich sie sind so solange sonst über um und unter vom von vor wann war was weil welche wenn werden wie wird wir wurde zu zum zur zwischen damit",
    "fr": "afin au aucun aucune aux avant avec ce ces cet cette chaque comme d dans de des donc du elle elles en encore est et eux fait il ils je l la le les leur leurs lors lorsque mais même n ne ni nous on ont ou où par parce pas peut plus pour qu quand que qui reste s sa sans se ses si son sont sous sur tant tous tout toute toutes très un une vers vous",
    "es": "a al ante antes aunque bajo cada como con cuando de del desde donde el ella ellas en entre era es esa ese eso esta este esto fue ha hasta hay la las le les lo los más mientras muy ni ningún no nos o para pero por porque pues que quien se ser si sin sobre solo son su sus también tan todas todo todos un una uno y ya sigue",
    "pt": "a ao aos antes apenas as até cada com como da das de dela dele depois do dos e ela elas ele eles em enquanto entre era essa esse esta este eu foi há isso isto já lhe mais mas me mesmo muito na nas nem nenhum no nos não o os ou para pela pelo por porque qual quando que quem se sem ser seu seus sua suas são também todas todo todos um uma é",
    "it": "a agli ai al alla alle allo anche che chi ci come con così cui da dagli dai dal dalla dalle dato degli dei del della delle dello di dove e ed era fino finché gli ha ho i il in io la le lo loro ma mentre ne negli nei nel nella nelle nessun nessuno noi non o ogni per perché più poi prima quale quando quella quello questa questo qui se senza si solo sono su sua sue sui sul sulla suo tra tutte tutti un una uno vada è",
    "pl": "a aby albo ale ani bez bo by był być chociaż co czy dla do dopóki gdy gdyby gdzie go i ich ile im inne iż ja jak jako je jednak jego jej jest jeszcze jeśli już każdy kiedy kto która które który lub ma mnie może można na nad nam nas nie niech nim o od on ona one oni oraz pan po pod ponieważ poza przed przez przy są się stąd ta tak także tam te tego tej ten to trwa tu tylko tym u w we wszystkie wszystko z za zanim ze zostanie że żeby żaden żadne",
    "ru": "а без был быть в вам вас весь во вот все всё вы где да даже для до его ее её если есть ещё еще ж же за и из или им их к как когда которая которые который кто ли между меня мне может мы на над нам нас не него нет ни но ну о об однако он она они оно от по под пока после потому при про раз с сам себя со так такой там тем то того тоже только том тот ты у уже чего чем что чтобы эта эти это этот я прежде",
    "zh": "的 了 在 是 我 有 和 就 不 都 一 也 很 到 要 去 你 会 着 没 看 好 这 那 他 她 它 们 与 及 或 但 因 为 所 以 而 当 时 从 把 被 对 于 个 每 已 未 后 前 中 上 下 止 如 此",
}
WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
#: Languages of each word.
LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _language, _words in WORDS.items():
    for _word in _words:
        LANGUAGES_OF[_word] = (*LANGUAGES_OF.get(_word, ()), _language)
